"""Jobs made of operators: training, validation, scoring, comparison, triage."""
