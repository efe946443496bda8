"""DataFrame operators: preparation, features, labels, sampling, metrics, triage, explanations."""
