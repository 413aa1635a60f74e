"""papyrine: document analytics as Spark DataFrame plans."""
