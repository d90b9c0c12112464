"""Tables in and archive objects out."""
