"""Typed, model-level queries and change tracking over DataFrames."""

from tessera.catalog import Attribute, Catalog, Entity, Relationship
from tessera.operators.fetch import FetchRequest, fetch, fetch_count, fetch_identifiers, fetch_sectioned
from tessera.store import Store

__all__ = ["Attribute", "Catalog", "Entity", "FetchRequest", "Relationship", "Store", "fetch", "fetch_count", "fetch_identifiers", "fetch_sectioned"]
