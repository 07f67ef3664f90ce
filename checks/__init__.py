"""Registered queries and the independent SQL each is compared with."""
