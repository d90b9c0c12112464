"""Plans over the registry: what to create, split, archive and drop. Registries are small; rows never come here."""
