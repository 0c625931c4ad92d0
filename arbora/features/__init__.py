"""Feature matrices for machine learning."""
