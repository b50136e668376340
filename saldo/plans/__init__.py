"""Registered queries. Importing the modules fills the registry."""

from saldo.plans import core, extras, ingestion, insights, mutations, reports  # noqa: F401
