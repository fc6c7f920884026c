"""DataFrame-to-DataFrame operators: panel, checks, features, nowcasts, comparisons, tracking."""
