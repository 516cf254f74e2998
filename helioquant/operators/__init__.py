"""DataFrame-in, DataFrame-out operators; none of them runs an action."""
