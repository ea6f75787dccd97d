"""readsift: assignment of sequences to categories as DataFrame transformations."""
