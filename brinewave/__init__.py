"""Labelled multichannel recordings as composable DataFrame transformations."""
