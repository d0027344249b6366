"""Rules as data, compiled to DataFrame plans."""
