"""Panels kept up to date as register files arrive."""
