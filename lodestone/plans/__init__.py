"""Plans: from settled contents of files to an ordered, reversible list of changes."""
