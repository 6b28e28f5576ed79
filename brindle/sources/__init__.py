from brindle.sources.catalog import SCHEMAS, Tables

__all__ = ["SCHEMAS", "Tables"]
