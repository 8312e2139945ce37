"""Frontends that cut source documents into units."""
