"""Line dedup: SimHash of normalised lines, joined on pigeonhole blocks, checked by edit similarity.

One occurrence of each group of linked lines stays. All of it is built-in expressions. A line's features are its
shingles of a few words, all of a short line and a sample by hash of a longer one; SimHash turns them to 64 bits, and
fingerprints that differ in up to RADIUS bits agree in BLOCKS - RADIUS of the blocks at least, which are the buckets.
SimHash alone can't reach SIMILARITY: one edited word in ten moves nine bits or so, more than blocks can cover. So the
features are buckets of their own as well: lines meet in whatever either finds, and edit similarity, counted in words,
decides. Lines under sixteen words surely meet if they are similar; the share of longer ones is in the README.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, scratch

#: Lines are linked at SIMILARITY, 1 - edited words / words of the longer; all shorter ones link if equal.
SIMILARITY, SHORTEST = 0.8, 4
#: Fingerprints' blocks of bits, and the differing bits for which they find every pair.
BLOCKS, RADIUS = 4, 2
#: Features have three words in lines under LONG[1], four in lines from LONG[0], so that similar lines have one kind in
#: common. A line of n words keeps one in the largest power of two up to n / LEAST: LEAST to 2 * LEAST of them.
LONG, LEAST = (16, 20), 8
#: A word is one of SYMBOLS code points, from the one after the surrogates, when edits are counted.
SYMBOLS, SURROGATES = 1 << 20, 0x10000
#: Longs of word parities, powers of two: of all candidates, and of those of over WIDE words that the rounds leave.
PARITIES, FINE, WIDE = 4, 16, 300
#: Rounds of comparison with one line a bucket, before the pairs that are left.
PIVOTS = 2
#: Of the lines that the rounds leave, so many of the most frequent words come last when their rarest are taken.
FREQUENT = 1024
#: Up to so many links are grouped on the driver, 16 bytes each; more of them in Spark.
FEW = 1 << 18
#: Up to so many features are counted in generated code, more of them in a fold.
FEATURES = 24
#: A line's id has its number of words, up to MOST_WORDS, in the bits from ID_BITS on, and below these its part.
ID_BITS, MOST_WORDS = 51, (1 << 12) - 1
#: The distinct lines are made and looked up in so many parts, by hash and one after the other: so much less is in shuffle files at once.
PARTS = 2
#: What stands between words in a line, each character named: Java looks such a class up in a table.
BETWEEN = "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum() and c != 10)
#: All of that but single spaces, which stay as they are. It begins with one class, so that Java passes by words quickly.
UNEVEN = f"[{BETWEEN}](?:(?<! )[{BETWEEN}]*+|[{BETWEEN}]++)"


def norms_of(text: Column) -> Column:
    """The normalised lines of a text: lower-cased words with a space between, without ASCII punctuation and control characters."""
    return F.split(F.regexp_replace(F.lower(text), UNEVEN, " "), "\n", -1)


def _lanes(hashes: Column, width: int, few: int = 0) -> Column:
    """SimHash of up to 2 ** (width - 1) - 1 hashes, or the first ``few``: counters in lanes of ``width`` bits, whose top bit stays clear.

    Sum k counts bits k, k + width, ... Adding what lifts a count over half past the lane's second-highest bit leaves
    the majority there.
    """
    ones = sum(1 << k for k in range(0, 64, width))

    def count(k: int) -> Column:
        lane = lambda h: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(ones))
        if few:
            return sum((lane(F.coalesce(F.get(hashes, F.lit(i)), F.lit(0).cast("long"))) for i in range(1, few)), lane(F.get(hashes, F.lit(0))))
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + lane(h))

    need = F.floor(F.size(hashes) / 2).cast("long")
    top = 1 << width - 2
    out = None
    for k in range(width):
        raised = (count(k) + (F.lit(top - 1).cast("long") - need) * F.lit(ones)).bitwiseAND(F.lit(ones * top))
        bits = F.shiftleft(F.shiftrightunsigned(raised, width - 2), k)
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def simhash(hashes: Column) -> Column:
    """A bit is 1 if it is set in over half of the hashes; narrow lanes for few of them, wider ones beyond. None: null."""
    n = F.size(hashes)
    some = F.when(n <= FEATURES // 2, _lanes(hashes, 8, FEATURES // 2)).when(n <= FEATURES, _lanes(hashes, 8, FEATURES))
    return some.when(n < 1 << 6, _lanes(hashes, 8)).when(n < 1 << 14, _lanes(hashes, 16)).otherwise(_lanes(hashes, 32))


def block_keys(fp: Column) -> list[Column]:
    """A key for every choice of BLOCKS - RADIUS blocks: fingerprints within RADIUS bits share one of them."""
    width, keys = 64 // BLOCKS, []
    for k, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS)):
        mask = sum(((1 << width) - 1) << width * b for b in chosen)
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return keys


def _edits(words: Column) -> Column:
    """The most edited words that SIMILARITY allows."""
    return F.floor(F.lit(round(1 - SIMILARITY, 9)) * words + F.lit(1e-9)).cast("int")


def _joined(a: str, b: str, ahead: int) -> Column:
    """Hashes of each element of ``a`` with the one of ``b`` that stands ``ahead`` further, as far as both go.

    The words' own hashes are mixed well, so one more shift a place is enough to tell the order.
    """
    reach = F.greatest(F.size(b) - ahead, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), reach), F.slice(b, F.lit(ahead + 1), reach), lambda x, y: x.bitwiseXOR(F.shiftrightunsigned(y, ahead)))


def with_buckets(lines: DataFrame) -> DataFrame:
    """``lines`` (with norm and n) and their ``buckets``: features, and blocks of the features' SimHash.

    A feature is kept if its hash is 0 modulo a power of two, n / LEAST or less (if there is none, the least one): what
    a longer line keeps, a shorter one keeps too, so similar lines keep the same of what they share. An edit takes three
    runs of three words at most and lines under 2 * LEAST words keep all of theirs, so that similar ones share one. Only
    where the middle of five words differs or is left out, they share no more than pairs of words.
    """
    n, none = F.col("n"), F.array().cast("array<long>")
    sieve = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.log2(F.greatest(F.lit(1.0), n / LEAST))).cast("int")) - 1
    out = lines.withColumn("words", F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)))
    out = out.withColumn("twos", _joined("words", "words", 1)).withColumn("sieve", sieve)
    out = out.withColumn("threes", F.when(n < LONG[1], _joined("twos", "words", 2)).otherwise(none))
    out = out.withColumn("fours", F.when(n >= LONG[0], _joined("twos", "twos", 2)).otherwise(none))
    for runs in ("threes", "fours"):
        some = out.withColumn("some", F.filter(runs, lambda x: x.bitwiseAND(F.col("sieve")) == 0))
        least = F.array_compact(F.array(F.array_min(runs)))
        out = some.withColumn(runs, F.when(F.size("some") > 0, F.col("some")).otherwise(least))
    out = out.withColumn("features", F.when(n < LONG[1], F.col("threes")).otherwise(F.col("fours")))
    out = out.withColumn("fp", simhash(F.col("features")))
    pairs = F.when(n <= 5, F.col("twos")).otherwise(none)
    found = F.array_distinct(F.concat("threes", "fours", pairs, F.array(*block_keys(F.col("fp")))))
    return out.select(*lines.columns, F.when(n >= SHORTEST, found).otherwise(none).alias("buckets"))


def with_id(lines: DataFrame, part: int = 0) -> DataFrame:
    """``lines`` (with n) and their ``id``: in the order of their numbers of words, up to MOST_WORDS; those of two parts differ."""
    head = F.call_function("shiftleft", F.least("n", F.lit(MOST_WORDS)).cast("long"), F.lit(ID_BITS))
    head = head.bitwiseOR(F.lit(part << ID_BITS - PARTS.bit_length() + 1).cast("long"))
    return lines.withColumn("id", head.bitwiseOR(F.monotonically_increasing_id()))


def part_of(line: Column) -> Column:
    """The part that an id is of."""
    return F.shiftrightunsigned(line, ID_BITS - PARTS.bit_length() + 1).bitwiseAND(F.lit(PARTS - 1))


def in_company(keyed: DataFrame) -> DataFrame:
    """Rows (bucket, id) whose bucket has another line of a length that similarity allows.

    In the order of lengths, the next shorter and the next longer line are those that could be near enough, if any is.
    """
    def words(line: Column) -> Column:
        return F.shiftrightunsigned(line, ID_BITS)

    def fits(short: Column, long: Column) -> Column:
        return F.coalesce(words(long) - words(short) <= _edits(words(long)), F.lit(False))

    ends = Window.partitionBy("bucket")  # by itself, and so sorted by radix; most buckets hold one line
    rows = keyed.select("bucket", "id", F.min("id").over(ends).alias("least"), F.max("id").over(ends).alias("most"))
    beside = Window.partitionBy("bucket").orderBy("id")
    rows = rows.where("least < most").select("bucket", "id", F.lag("id").over(beside).alias("lo"), F.lead("id").over(beside).alias("hi"))
    return rows.where(fits(F.col("lo"), F.col("id")) | fits(F.col("id"), F.col("hi"))).select("bucket", "id")


def _symbols(hashes: Column) -> Column:
    """A string with one symbol for each word; two words have the same one once in SYMBOLS times."""
    point = lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit(SYMBOLS - 1)) + F.lit(SURROGATES)), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(hashes, point), "")), "UTF-32")


def _parities(hashes: Column, longs: int = PARITIES) -> list[Column]:
    """``longs`` longs of bits: one is 1 if an odd number of hashes have its number in their last bits."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    part = lambda k: F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(longs - 1)) == k)
    return [F.aggregate(part(k), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h))).alias(f"p{k}") for k in range(longs)]


def _near(x: str, y: str, longs: int = PARITIES) -> Column:
    """Whether two rows could be similar by their numbers of words and the parities of their words' hashes.

    A changed word changes two bits at most, one more or less changes one, so no similar pair is let go. Lines of over 75 words a long mostly pass.
    """
    a, b = F.col(f"{x}n"), F.col(f"{y}n")
    most = _edits(F.greatest(a, b))
    apart = sum(F.bit_count(F.col(f"{x}p{k}").bitwiseXOR(F.col(f"{y}p{k}"))) for k in range(longs))
    return (F.abs(a - b) <= most) & (apart <= 2 * most - F.abs(a - b))


def _hashes(norm: str = "norm") -> Column:
    """The words' hashes."""
    return F.transform(F.split(norm, " "), lambda w: F.xxhash64(w))


def _verified(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """Pairs (u, v) of lines (id, code) that are similar enough."""
    both = pairs.join(codes.select(F.col("id").alias("u"), F.col("code").alias("a")), "u")
    both = both.join(codes.select(F.col("id").alias("v"), F.col("code").alias("b")), "v")
    both = both.withColumn("most", _edits(F.greatest(F.length("a"), F.length("b"))))
    return both.where(F.expr("levenshtein(a, b, most) >= 0")).select("u", "v")


def _groups(links: DataFrame, name: str) -> DataFrame:
    """(node, component) as connected_components() has them; up to FEW links are joined on the driver."""
    if links.count() > FEW:
        return connected_components(links, name)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for u, v in links.select("u", "v").collect():
        a, b = top(u), top(v)
        above[max(a, b)] = min(a, b)
    return links.sparkSession.createDataFrame([(x, top(x)) for x in list(above)], "node long, component long")


def rare_words(lines: DataFrame) -> DataFrame:
    """``lines`` (with words, hashes without repeats, and n) and their ``rare`` words: similar lines share one of them.

    Up to a quarter of a line's words are missing in a similar one (a fifth of the longer's), so in any order of all
    words the first n / 4 + 1 of both have one in common. Here the FREQUENT most frequent come last, so that what many
    lines repeat is no line's rare word unless nearly all of it is repeated.
    """
    often = lines.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    often = often.orderBy(F.desc("times"), "word").limit(FREQUENT).agg(F.sort_array(F.collect_list(F.struct("times", "word"))).alias("often"))
    often = often.select(F.transform("often", lambda x: x["word"]).alias("often"))
    last = F.array_intersect("often", "words")
    ordered = F.concat(F.sort_array(F.array_except("words", last)), last)  # the one of few words is made a set
    first = F.floor(F.col("n") / 4 + F.lit(1e-9)).cast("int") + 1
    return lines.crossJoin(F.broadcast(often)).withColumn("rare", F.slice(ordered, F.lit(1), first)).drop("often")


def _left_pairs(told: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (u, v) of different families, among the lines in buckets that more than one family is in.

    A bucket may hold a passage of many lines that aren't similar, whose pairs would grow with the square of their
    number. So the buckets only say which lines are left; these meet in their rare words, which misses no similar pair.
    Only lines of over WIDE words, which PARITIES longs hardly tell apart, carry more along.
    """
    several = told.groupBy("bucket").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo < hi")
    left = told.join(several.select("bucket"), "bucket", "left_semi").select("id", "family").distinct()
    left = materialize(lines.select("id", "n", "norm").join(left, "id").withColumn("all", _hashes()), "line-left")
    fine = F.when(F.col("n") >= SIMILARITY * WIDE, F.array(*_parities(F.col("all"), FINE))).alias("fine")
    left = left.select("id", "family", "n", *_parities(F.col("all")), fine, F.array_distinct("all").alias("words"))
    left = rare_words(materialize(left, "line-left")).drop("words")
    left = left.withColumn("rare", F.transform("rare", lambda w: F.shiftright(w, 32).cast("int")))  # two that are one now only meet more lines
    left = materialize(left, "line-rare")  # or explode's filter makes it thrice
    x, y = F.col("a.n"), F.col("b.n")
    most = _edits(F.greatest(x, y))
    meet = (F.col("a.word") == F.col("b.word")) & (F.col("a.id") > F.col("b.id")) & (F.col("a.family") != F.col("b.family")) & _near("a.", "b.")
    apart = F.aggregate(F.zip_with("a.fine", "b.fine", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)
    once = F.array_min(F.array_intersect("a.rare", "b.rare")) == F.col("a.word")  # not once for each word they share

    def pairs(rows: DataFrame, more: Column) -> DataFrame:
        return rows.alias("a").join(rows.alias("b"), meet & more).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))

    word = F.explode("rare").alias("word")
    own = ("id", "family", "n", *[f"p{k}" for k in range(PARITIES)], "rare")
    short = pairs(left.where(F.col("n") <= WIDE).select(*own, word), once)
    wide = left.where("fine IS NOT NULL").select(*own, "fine", word)
    wide = pairs(wide, (F.greatest(x, y) > WIDE) & (apart <= 2 * most - F.abs(x - y)) & once)
    return materialize(short.union(wide), "line-rest")


def _name() -> Column:
    """A hash of the set of lines in a bucket."""
    return F.bit_xor(F.xxhash64("id"))


def once_each(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, id, more), each set of lines once: buckets are named by a hash of their lines and those alike fall together.

    Similar lines meet in most of their features, all of which say the same. If two sets have one hash, they are one
    bucket, which loses no pair.
    """
    return rows.withColumn("bucket", _name().over(Window.partitionBy("bucket"))).dropDuplicates(["bucket", "id"])


def fuzzy_links(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that connect all similar lines that meet, among the distinct (id, norm, n, times, more) in all parts; and the rows of these, without times.

    First the buckets' lines that have any candidate there at all, by length, then by words. Then, PIVOTS times, each bucket's lines are compared
    with one of them, the most frequent, which variants are most likely made from; what that links is joined to groups,
    and the next one comes from another group. Only pairs of different groups are left to compare at the end. A family
    of thousands of variants thus costs about a comparison a line, and no connection is lost.
    """
    unique = reduce(DataFrame.union, parts)
    keyed = with_buckets(unique.select("id", "n", "norm")).select(F.explode_outer("buckets").alias("bucket"), "id")
    keyed = keyed.where("bucket IS NOT NULL")  # explode's own filter makes buckets twice
    shared = materialize(once_each(in_company(keyed)), "line-shared")
    found = []
    for k, part in enumerate(parts):
        ids = shared.select("id").where(part_of(F.col("id")) == k).distinct()
        some = part.withColumn("times", F.col("times").cast("int")).join(ids, "id", "left_semi").withColumn("words", _hashes())
        found.append(materialize(some.select(*part.columns, *_parities(F.col("words"))), "line-candidates"))
    lines = reduce(DataFrame.union, found)
    parities = [f"p{k}" for k in range(PARITIES)]
    met = materialize(shared.join(lines.select("id", "n", "times", *parities), "id"), "line-met")
    discard(shared)
    other = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.id") != F.col("b.id"))
    told = met.alias("a").join(met.alias("b"), other & _near("a.", "b."), "left_semi")
    told = materialize(told.withColumn("family", F.col("id")).withColumn("used", F.lit(None).cast("long")), "line-told")
    discard(met)
    more = [c for c in unique.columns if c != "times"]
    codes = lines.select(*more).join(told.select("id").distinct(), "id", "left_semi").withColumn("words", _hashes())
    codes = materialize(codes.select(*more, _symbols(F.col("words")).alias("code")), "line-codes")
    for part in found:
        discard(part)
    links, own = None, ("id", "n", *parities, "family")
    for _ in range(PIVOTS):
        heads = told.where("used IS NULL OR family <> used").groupBy("bucket").agg(F.max(F.struct("times", *own)).alias("head"))
        heads = materialize(heads.select("bucket", *[F.col(f"head.{c}").alias(f"head_{c}") for c in own]), "line-heads")
        pairs = told.join(heads, "bucket").where((F.col("family") != F.col("head_family")) & _near("", "head_"))
        pairs = materialize(pairs.select(F.col("id").alias("u"), F.col("head_id").alias("v")).distinct(), "line-pairs")
        found = materialize(_verified(pairs, codes), "line-links")
        links = found if links is None else links.union(found)
        groups = materialize(_groups(links, "line-families").withColumnRenamed("node", "id"), "line-families")
        family = F.coalesce("component", "id")
        used = heads.select("bucket", F.col("head_id").alias("id")).join(groups, "id", "left").select("bucket", family.alias("used"))
        told = told.drop("family", "used").join(groups, "id", "left").withColumn("family", family).drop("component")
        told = materialize(told.join(used, "bucket"), "line-told")  # a bucket without a head is of one family
    return links.union(_verified(_left_pairs(told, codes), codes)), codes


def cut_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, n_lines, pos, h1, h2, n, norm): a row for each line, and one without pos for null text."""
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    own = (F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), F.coalesce(ends + 1, F.lit(0)).alias("n_lines"))
    whole = docs.select(*own, "text")  # first, or they are made again for each line
    each = whole.select("doc_id", "tkey", "n_lines", F.posexplode_outer(norms_of(F.col("text"))).alias("pos", "norm"))
    each = each.withColumn("norm", F.trim("norm"))
    n = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    return materialize(each.select("doc_id", "tkey", "n_lines", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), "norm").alias("h2"), n.alias("n"), "norm"), "line-texts", "zstd")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, removed): for each document that loses lines, their places from 0 in order.

    A group is all lines that similarity links, directly or through others; lines equal after normalisation always
    link. The occurrence with the smallest (doc_id, hash of text, place) stays, null doc_ids last. Rows that repeat both
    doc_id and text are one row's copies and are treated alike. Lines without a word are never removed; null text has
    no lines; an empty table gives no rows. Lines are told apart by 128 bits.
    """
    return _repeated(cut_lines(docs))


def _repeated(texts: DataFrame) -> DataFrame:
    """repeated_lines() of what cut_lines() returns, which it deletes."""
    places = texts.where("norm <> ''")  # only here: before, it would have norms made twice
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tkey", "pos", "n", "norm")).alias("least")
    own = ("nameless", "doc_id", "tkey", "pos")
    first = F.struct(*[F.col(f"least.{c}").alias(c) for c in own]).alias("first")
    parts = []
    for k in range(PARTS):
        part = places.where(F.pmod(F.shiftrightunsigned("h2", 8), F.lit(PARTS)) == k).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), least)
        parts.append(materialize(with_id(part.select("h1", "h2", "times", first, "least.n", "least.norm"), k), "line-unique", "zstd"))
    unique = reduce(DataFrame.union, parts)
    slim = materialize(places.select("doc_id", "tkey", "pos", "h1", "h2"), "line-places")
    discard(texts)
    links, near = fuzzy_links(parts)
    groups = materialize(_groups(materialize(links, "line-links"), "line-groups"), "line-components")
    inside = near.select("id", "h1", "h2", "first").join(groups.withColumnRenamed("node", "id"), "id")
    inside = materialize(inside, "line-inside")
    stays = inside.groupBy("component").agg(F.min("first").alias("stays"))
    linked = inside.join(stays, "component").select("h1", "h2", "stays")
    known = linked.union(unique.where("times > 1").select("h1", "h2", "first"))  # a linked line's first isn't before what stays
    known = materialize(known.groupBy("h1", "h2").agg(F.min("stays").alias("stays")), "line-known")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tkey", "pos")
    lost = slim.join(known, ["h1", "h2"]).where(~place.eqNullSafe(F.col("stays")))
    return lost.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` (and n_chars counted anew, where there is such a column).

    One row for each input row, same columns; a document may be left with empty text.
    """
    with scratch():
        gone = materialize(repeated_lines(docs), "line-removed", keep=True).toDF("line_doc", "line_text", "line_gone")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.line_doc")) & (F.xxhash64("d.text") == F.col("g.line_text"))
    lost = F.col("g.line_gone")
    lines = F.split("d.text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    text = F.when(lost.isNull(), F.col("d.text")).otherwise(F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n"))
    own = {c: F.col(f"d.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return docs.alias("d").join(gone.alias("g"), same, "left").select(*[x.alias(c) for c, x in own.items()])


def line_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_lines, n_kept, removed (places from 0, joined by commas)."""
    with scratch():
        texts = cut_lines(docs)
        heads = texts.where("pos = 0 OR pos IS NULL")
        slim = materialize(heads.select("doc_id", "tkey", F.col("n_lines").cast("long").alias("n_lines")), "line-docs", keep=True)
        gone = materialize(_repeated(texts), "line-removed", keep=True).toDF("line_doc", "line_text", "line_gone")
    same = F.col("doc_id").eqNullSafe(F.col("line_doc")) & (F.col("tkey") == F.col("line_text"))
    lost = F.coalesce(F.when(F.col("line_gone").isNotNull(), F.size("line_gone")), F.lit(0))
    return slim.join(gone, same, "left").select(
        "doc_id", "n_lines", (F.col("n_lines") - lost).alias("n_kept"), F.coalesce(F.array_join("line_gone", ","), F.lit("")).alias("removed")
    )
