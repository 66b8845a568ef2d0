"""Readers and writers of the records that networks and series are made of."""
