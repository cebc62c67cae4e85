"""Multi-job plans: fixed points, balancing loops and size-aware joins."""
