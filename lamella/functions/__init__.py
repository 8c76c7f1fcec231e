"""Column functions: presence and defaults, lists, dictionaries, unions, text."""
