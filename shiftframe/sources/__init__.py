"""Sources: element tables, profiles, the events adapter, files."""
