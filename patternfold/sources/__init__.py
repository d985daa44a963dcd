"""Reading observations from files and Python values, and writing state."""
