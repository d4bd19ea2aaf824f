"""Plans: the operators applied to whole tables."""
