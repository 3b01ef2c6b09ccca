"""Plan building blocks that several operators share."""
