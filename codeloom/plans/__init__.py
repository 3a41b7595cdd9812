"""Plans that build graph tables from other tables."""
