"""Daily plans: which fields are due, in what order."""
