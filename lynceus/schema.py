"""The nested entity record and the records around it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADDRESS = "line1: string, line2: string, city: string, state: string, postal_code: string, country: string"
GOV_ID = "id_type: string, identifier: string, country: string"
PARTS = {
    "person": f"struct<name: string, alt_names: array<string>, gender: string, birth_date: date, death_date: date, place_of_birth: string, titles: array<string>, government_ids: array<struct<{GOV_ID}>>>",
    "business": f"struct<name: string, alt_names: array<string>, created: date, dissolved: date, government_ids: array<struct<{GOV_ID}>>>",
    "organization": f"struct<name: string, alt_names: array<string>, created: date, dissolved: date, government_ids: array<struct<{GOV_ID}>>>",
    "aircraft": "struct<name: string, alt_names: array<string>, type: string, flag: string, built: string, icao_code: string, model: string, serial_number: string>",
    "vessel": "struct<name: string, alt_names: array<string>, imo_number: string, type: string, flag: string, built: string, mmsi: string, call_sign: string, tonnage: string, owner: string>",
}
DDL = ", ".join(
    [
        "index_pos long", "id string", "name string", "entity_type string", "source string", "source_id string", *[f"{k} {v}" for k, v in PARTS.items()],
        "contact struct<email: string, phone: string, fax: string, website: string>", f"addresses array<struct<{ADDRESS}>>", "crypto_addresses array<struct<currency: string, address: string>>",
        "alt_names array<string>", f"government_ids array<struct<{GOV_ID}>>", "sanctions struct<programs: array<string>, secondary: boolean, description: string>",
        "historical array<struct<type: string, value: string, date: date>>", "remarks string",
        "prepared struct<name: string, alt_names: array<string>, without_stopwords: array<string>, without_company_titles: array<string>, word_forms: array<string>, addresses: array<string>, language: string>",
    ]
)


def entity_schema() -> T.StructType:
    return T.StructType.fromDDL(DDL)


def part(kind: str, **values: Column) -> Column:
    """A type struct with the given fields, the others null."""
    fields = T.DataType.fromDDL(PARTS[kind]).fields
    return F.struct(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def as_entities(df, **columns: Column):
    """df as entities: the given columns, all others null of their type."""
    return df.select(*[(columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in entity_schema().fields])
