"""Column roles: the declared schema every operator works from."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERICAL, CATEGORICAL, BOOLEAN, DATETIME, ID, TEXT = "numerical", "categorical", "boolean", "datetime", "id", "text"

# Declared numeric representation -> Spark type, smallest and largest value.
REPRESENTATIONS: dict[str, tuple[T.DataType, int | None, int | None]] = {
    "Int8": (T.ByteType(), -(2**7), 2**7 - 1),
    "Int16": (T.ShortType(), -(2**15), 2**15 - 1),
    "Int32": (T.IntegerType(), -(2**31), 2**31 - 1),
    "Int64": (T.LongType(), -(2**63), 2**63 - 1),
    "UInt8": (T.ShortType(), 0, 2**8 - 1),
    "UInt16": (T.IntegerType(), 0, 2**16 - 1),
    "UInt32": (T.LongType(), 0, 2**32 - 1),
    "UInt64": (T.DecimalType(20, 0), 0, 2**64 - 1),
    "Float": (T.DoubleType(), None, None),
}

DEFAULT_ENCODER = {
    NUMERICAL: "float_format",
    CATEGORICAL: "uniform",
    BOOLEAN: "binary",
    DATETIME: "unix_timestamp",
}


@dataclass(frozen=True)
class Column:
    name: str
    role: str
    repr: str | None = None
    order: tuple[str, ...] | None = None
    target: bool = False
    datetime_format: str | None = None
    encoder: str | None = None

    @property
    def spark_type(self) -> T.DataType:
        if self.role == NUMERICAL:
            return REPRESENTATIONS[self.repr or "Float"][0]
        return {BOOLEAN: T.BooleanType(), DATETIME: T.TimestampNTZType()}.get(self.role, T.StringType())

    @property
    def default_encoder(self) -> str | None:
        if self.encoder:
            return self.encoder
        if self.role == CATEGORICAL and self.order:
            return "ordered_label"
        return DEFAULT_ENCODER.get(self.role)


@dataclass(frozen=True)
class Roles:
    columns: tuple[Column, ...] = field(default_factory=tuple)
    quasi: tuple[str, ...] = ()  # quasi-identifiers; every feature if none is named

    def __iter__(self):
        return iter(self.columns)

    def __getitem__(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def quasi_identifiers(self) -> list[str]:
        return list(self.quasi) or self.features

    def of(self, *roles: str, within: Iterable[str] | None = None) -> list[str]:
        """Names of the columns with one of the roles, restricted to `within` when given."""
        keep = None if within is None else set(within)
        return [c.name for c in self.columns if c.role in roles and (keep is None or c.name in keep)]

    def incompatible(self, asked: Sequence[str], *roles: str) -> list[str]:
        """Names asked for that do not have one of the roles."""
        fit = set(self.of(*roles))
        return [a for a in asked if a not in fit]

    @property
    def target(self) -> str:
        return next(c.name for c in self.columns if c.target)

    @property
    def row_id(self) -> str:
        return self.of(ID)[0]

    @property
    def features(self) -> list[str]:
        return [c.name for c in self.columns if c.role not in (ID, TEXT)]

    def struct(self) -> T.StructType:
        """Spark schema with role, order and representation in the field metadata."""
        fields = []
        for c in self.columns:
            meta: dict = {"role": c.role}
            if c.repr:
                meta["representation"] = c.repr
            if c.order:
                meta["order"] = list(c.order)
            if c.target:
                meta["target"] = True
            fields.append(T.StructField(c.name, c.spark_type, True, meta))
        return T.StructType(fields)

    @staticmethod
    def from_struct(schema: T.StructType) -> Roles:
        cols = []
        for f in schema.fields:
            m = f.metadata
            order = tuple(m["order"]) if "order" in m else None
            cols.append(Column(f.name, m.get("role", TEXT), m.get("representation"), order, bool(m.get("target"))))
        return Roles(tuple(cols))

    @staticmethod
    def from_metadata(doc: dict) -> Roles:
        """Roles from a metadata document: {"columns": {name: {"sdtype": ..., ...}}}."""
        if "columns" not in doc:
            raise ValueError("metadata has no 'columns'")
        known = {NUMERICAL, CATEGORICAL, BOOLEAN, DATETIME, ID}
        cols = []
        for name, info in doc["columns"].items():
            kind = info.get("sdtype")
            cols.append(
                Column(
                    name,
                    kind if kind in known else TEXT,
                    info.get("computer_representation"),
                    datetime_format=info.get("datetime_format"),
                )
            )
        return Roles(tuple(cols))

    def metadata(self) -> dict:
        cols: dict = {}
        for c in self.columns:
            cols[c.name] = {"sdtype": c.role}
            if c.role == NUMERICAL and c.repr:
                cols[c.name]["computer_representation"] = c.repr
            if c.datetime_format:
                cols[c.name]["datetime_format"] = c.datetime_format
        return {"METADATA_SPEC_VERSION": "SINGLE_TABLE_V1", "columns": cols}

    def encoding(self) -> dict[str, str]:
        """Column -> encoder name."""
        return {c.name: c.default_encoder for c in self.columns if c.default_encoder}

    def encoding_document(self) -> dict:
        """The encoding document: roles plus one encoder entry with parameters per column."""
        entries: dict = {}
        for c in self.columns:
            if not c.default_encoder:
                continue
            params: dict = {}
            if c.role == NUMERICAL:
                params = {
                    "computer_representation": c.repr or "Float",
                    "enforce_min_max_values": True,
                    "learn_rounding_scheme": True,
                }
            elif c.order:
                params = {"order": list(c.order)}
            entries[c.name] = {"type": c.default_encoder, "params": params}
        return {"sdtypes": {c.name: c.role for c in self.columns}, "transformers": entries}


def select_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Required-column projection; a missing column is an error."""
    missing = [n for n in roles.names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing from source: {missing}")
    return df.select(*roles.names)
