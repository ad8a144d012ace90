"""Reading raw measurements, flag lists and stage tables, and writing them back."""
