"""From a client's own tables to canonical events, as compiled column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronlens.functions.columns import apply_rule, first_present, mobile_substring, non_empty, parse_instant, whole_number

# The event types.
EVENT_TYPES = (
    "session_start", "view_category", "view_item", "add_to_cart", "checkout", "purchase", "purchase_item",
    "refund", "refund_item", "delivery_events",
)

# Canonical source type -> event type.
CANONICAL_TYPES = {
    "purchase": "purchase", "purchase_item": "purchase_item", "view_item": "view_item", "view_category": "view_category",
    "add_to_cart": "add_to_cart", "remove_from_cart": "add_to_cart", "checkout": "checkout",
    "session_start": "session_start", "session_end": "session_start", "page_view": "view_item",
    "search": "view_category", "refund": "refund", "wishlist_add": "view_item", "email_open": "session_start",
    "email_click": "view_item", "custom": "view_item",
}

# Table name -> event type for file folders; any other table is a view_item.
FOLDER_TABLE_TYPES = {
    "purchase": "purchase", "purchase_item": "purchase_item", "view_item": "view_item", "view_category": "view_category",
    "cart_update": "add_to_cart", "add_to_cart": "add_to_cart", "checkout": "checkout", "session_start": "session_start",
    "session_end": "session_start", "page_visit": "view_item", "search": "view_category",
}

# Common table name -> canonical source type; any other table is custom.
TABLE_TYPES = {
    "purchase": "purchase", "purchases": "purchase", "order": "purchase", "orders": "purchase",
    "transaction": "purchase", "transactions": "purchase",
    "purchase_item": "purchase_item", "order_item": "purchase_item", "line_item": "purchase_item",
    "view_item": "view_item", "product_view": "view_item", "item_view": "view_item", "pdp_view": "view_item",
    "view_category": "view_category", "category_view": "view_category", "plp_view": "view_category",
    "cart_update": "add_to_cart", "add_to_cart": "add_to_cart", "cart_add": "add_to_cart", "cart": "add_to_cart",
    "checkout": "checkout", "begin_checkout": "checkout",
    "session_start": "session_start", "session_begin": "session_start", "visit_start": "session_start",
    "session_end": "session_end", "visit_end": "session_end",
    "page_visit": "page_view", "page_view": "page_view", "pageview": "page_view",
    "search": "search", "site_search": "search",
    "refund": "refund", "return": "refund",
}

# Tables of a folder that hold customers, not events.
NON_EVENT_TABLES = ("customers_properties", "customers_id_history", "customers_external_ids", "merge")

# Source names per target property, in order of preference.
ALIASES = {
    "product_id": ("product_id", "item_id", "sku"),
    "product_name": ("title", "product_name", "item_name", "name"),
    "product_price": ("price", "product_price", "item_price", "unit_price"),
    "quantity": ("quantity", "total_quantity", "qty", "item_quantity"),
    "device_type": ("device", "device_type", "channel", "platform"),
    "search_query": ("query", "search_query", "search_term", "keyword"),
    "page_url": ("page_url", "url", "page_location"),
    "page_title": ("page_title", "title", "page_name"),
    "category_level_1": ("category_level_1", "category_1", "main_category"),
    "category_level_2": ("category_level_2", "category_2", "subcategory"),
    "category_level_3": ("category_level_3", "category_3", "sub_subcategory"),
    "order_id": ("purchase_id", "order_id", "transaction_id", "order_number"),
    "session_id": ("session_id", "session", "visit_id"),
}
# Source names of the category and of the revenue, in order of preference.
CATEGORY_FIELDS = ("product_category", "category", "category_level_1", "category_name", "item_category", "product_type")
REVENUE_FIELDS = ("total_price", "order_total", "total_amount", "revenue", "transaction_total", "purchase_amount", "amount")
# Known keys that never go to the overflow map.
IGNORED_KEYS = ("browser", "os", "location", "timestamp", "ingest_timestamp", "type")

PROPERTY_TYPES = {"product_price": "decimal", "order_total": "decimal", "quantity": "whole"}


@dataclass(frozen=True)
class SourceConfig:
    """How one client names its fields; `type_field` and `type_values` split a table by row."""

    client_name: str = "default"
    customer_id_field: str = "internal_customer_id"
    timestamp_field: str = "timestamp"
    properties_field: str | None = "properties"
    table_types: Mapping[str, str] = field(default_factory=dict)
    type_field: str | None = None
    type_values: Mapping[str, str] = field(default_factory=dict)
    id_history_table: str | None = None
    past_id_field: str = "past_id"
    canonical_id_field: str = "internal_customer_id"
    category_fields: tuple[str, ...] = CATEGORY_FIELDS
    revenue_fields: tuple[str, ...] = REVENUE_FIELDS
    mobile_values: tuple[str, ...] = ("mobile", "tablet", "ios", "android")


# Field and table names of known sources.
def bloomreach() -> SourceConfig:
    return SourceConfig(
        "bloomreach",
        table_types={"purchase": "purchase", "view_item": "view_item", "cart_update": "add_to_cart",
                     "session_start": "session_start", "search": "search"},
        id_history_table="customers_id_history",
        category_fields=("category_level_1", "category_level_2", "product_category"),
        revenue_fields=("total_price", "total_price_local_currency"),
    )


def ga4() -> SourceConfig:
    return SourceConfig(
        "ga4", "user_pseudo_id", "event_timestamp", "event_params",
        type_field="event_name",
        type_values={"purchase": "purchase", "view_item": "view_item", "add_to_cart": "add_to_cart",
                     "session_start": "session_start"},
        revenue_fields=("value", "transaction_revenue"), mobile_values=("mobile", "tablet"),
    )


def segment() -> SourceConfig:
    return SourceConfig(
        "segment", "user_id", "timestamp", None,
        table_types={"tracks": "custom", "order_completed": "purchase", "product_viewed": "view_item",
                     "product_added": "add_to_cart"},
        id_history_table="identifies", past_id_field="anonymous_id", canonical_id_field="user_id",
        revenue_fields=("total", "revenue", "value"),
    )


def generic(customer_id_field: str = "customer_id", timestamp_field: str = "timestamp") -> SourceConfig:
    return SourceConfig("generic", customer_id_field, timestamp_field, None)


PRESETS: dict[str, Callable[[], SourceConfig]] = {
    "bloomreach": bloomreach, "ga4": ga4, "segment": segment, "generic": generic,
}


def _lookup(pairs: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[key]


def canonical_type(table: Column) -> Column:
    """Canonical source type of a table name by its common synonyms."""
    return F.coalesce(_lookup(TABLE_TYPES, F.lower(table)), F.lit("custom"))


def event_type_of_table(table: Column, config: SourceConfig | None = None) -> Column:
    """Event type of a table; the client's own mapping wins over the synonyms."""
    kind = canonical_type(table)
    if config and config.table_types:
        kind = F.coalesce(_lookup(config.table_types, table), kind)
    return _lookup(CANONICAL_TYPES, kind)


def folder_event_type(table: Column) -> Column:
    return F.coalesce(_lookup(FOLDER_TABLE_TYPES, table), F.lit("view_item"))


def nested(frame: DataFrame, path: str) -> Column | None:
    """Column at a dotted path through structs, maps or JSON text; None when absent."""
    parts = path.split(".")
    kind: T.DataType = frame.schema
    column: Column | None = None
    for i, part in enumerate(parts):
        if isinstance(kind, T.StructType):
            if part not in kind.names:
                return None
            column = frame[part] if column is None else column.getField(part)
            kind = kind[part].dataType
        elif isinstance(kind, T.MapType):
            column, kind = column[part], kind.valueType
        elif isinstance(kind, T.StringType):
            return F.get_json_object(column, "$." + ".".join(parts[i:]))
        else:
            return None
    return column


def first_of(frame: DataFrame, paths: tuple[str, ...], prefix: str = "") -> Column:
    """First non-null value over several paths, as text."""
    found = [c for c in (nested(frame, prefix + p) for p in paths) if c is not None]
    texts = [c.cast("string") for c in found]
    return first_present(*texts) if texts else F.lit(None).cast("string")


def known_keys(config: SourceConfig) -> tuple[str, ...]:
    names = [a for group in ALIASES.values() for a in group]
    return tuple(dict.fromkeys([*names, *IGNORED_KEYS, config.customer_id_field, *config.revenue_fields, *config.category_fields]))


def overflow(frame: DataFrame, config: SourceConfig) -> Column:
    """Unknown non-null properties as a map; null when there are none."""
    known = known_keys(config)
    container = frame.schema[config.properties_field].dataType if config.properties_field else frame.schema
    if isinstance(container, T.MapType):
        extra = F.map_filter(F.col(config.properties_field).cast("map<string,string>"),
                             lambda k, v: ~k.isin(*known) & v.isNotNull())
    else:
        prefix = f"{config.properties_field}." if config.properties_field else ""
        names = [n for n in container.names if n not in known]
        if not names:
            return F.lit(None).cast("map<string,string>")
        extra = F.map_filter(
            F.create_map(*[x for n in names for x in (F.lit(n), F.col(prefix + n).cast("string"))]),
            lambda k, v: v.isNotNull())
    return F.when(F.size(extra) > 0, extra)


def event_key(table: Column, *parts: Column) -> Column:
    """Deterministic event id, so that a retried task writes the same ids."""
    return F.sha2(F.concat_ws("|", table, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def rows_to_events(frame: DataFrame, table: str, config: SourceConfig | None = None) -> DataFrame:
    """Canonical events of one source table; rows without customer or time are dropped."""
    config = config or SourceConfig()
    prefix = f"{config.properties_field}." if config.properties_field else ""
    customer = frame[config.customer_id_field].cast("string")
    raw_time = frame[config.timestamp_field]
    is_text = isinstance(frame.schema[config.timestamp_field].dataType, T.StringType)
    when = parse_instant(raw_time) if is_text else raw_time.cast("timestamp")
    if config.type_field and config.type_field in frame.columns:
        mapped = _lookup(config.type_values, frame[config.type_field])
        kind = F.coalesce(_lookup(CANONICAL_TYPES, mapped), F.lit("view_item"))
    else:
        kind = event_type_of_table(F.lit(table), config) if config.table_types else folder_event_type(F.lit(table))
    fields = []
    for target, names in ALIASES.items():
        text = first_of(frame, names, prefix)
        if target == "product_price":
            text = apply_rule(text, "decimal")
        elif target == "quantity":
            text = whole_number(text)
        else:
            text = non_empty(text)
        fields.append(text.alias(target))
    body = frame.select(
        event_key(F.lit(table), customer, raw_time, F.to_json(F.struct("*"))).alias("event_id"),
        customer.alias("customer_id"), kind.alias("event_type"), when.alias("ts"),
        F.lit(table).alias("source_table"), *fields,
        non_empty(first_of(frame, config.category_fields, prefix)).alias("product_category"),
        mobile_substring(non_empty(first_of(frame, ALIASES["device_type"], prefix)), config.mobile_values).alias("is_mobile"),
        apply_rule(first_of(frame, config.revenue_fields, prefix), "decimal").alias("order_total"),
        F.lit(None).cast("decimal(18,2)").alias("total_amount"),
        overflow(frame, config).alias("custom_properties"),
    )
    return body.where(non_empty(F.col("customer_id")).isNotNull() & F.col("ts").isNotNull())


@dataclass(frozen=True)
class FieldMapping:
    """Source path of a target field with a default and a conversion.

    `rule` is a rule name or a function from Column to Column; both stay in the JVM.
    """

    source: str
    rule: str | Callable[[Column], Column] | None = None
    default: object = None


@dataclass(frozen=True)
class EventTable:
    table: str
    event_type: str
    customer_id_field: str = "internal_customer_id"
    timestamp_field: str = "timestamp"
    date_field: str = "timestamp"
    mappings: Mapping[str, FieldMapping] = field(default_factory=dict)
    product_category_field: str | None = None
    filters: tuple[str, ...] = ()


# Target properties of an event.
TARGETS = (
    "page_url", "page_title", "product_id", "product_name", "product_category", "product_price", "quantity",
    "order_id", "order_total", "search_query", "session_id",
)


def mapped_value(frame: DataFrame, mapping: FieldMapping) -> Column:
    value = nested(frame, mapping.source)
    if value is None:
        value = F.lit(None).cast("string")
    if mapping.default is not None:
        value = F.coalesce(value, F.lit(mapping.default).cast(frame.select(value).schema[0].dataType))
    if callable(mapping.rule):
        return mapping.rule(value)
    return apply_rule(value, mapping.rule)


def product_list_categories(text: Column) -> Column:
    """Distinct categories inside a JSON product list, sorted."""
    items = F.from_json(text, "array<struct<category:string,product_category:string>>")
    names = F.transform(items, lambda p: F.coalesce(non_empty(p["category"]), non_empty(p["product_category"])))
    return F.array_sort(F.array_distinct(F.array_compact(names)))


def project_events(frame: DataFrame, config: EventTable) -> DataFrame:
    """Canonical events by explicit field mappings; other mapped fields go to a map."""
    values = {name: mapped_value(frame, m) for name, m in config.mappings.items()}
    if config.product_category_field:
        chosen = nested(frame, config.product_category_field)
        if chosen is not None:
            values["product_category"] = F.coalesce(non_empty(chosen.cast("string")), *[
                v for k, v in values.items() if k == "product_category"])
    devices = [non_empty(values[k].cast("string")) for k in ("device", "device_type") if k in values]
    null = F.lit(None).cast("string")
    extra_names = [n for n in values if n not in TARGETS and n not in ("device", "device_type")]
    extras = [x for n in extra_names for x in (F.lit(n), values[n].cast("string"))]
    if config.event_type == "purchase" and "product_list" in values:
        extras += [F.lit("product_categories"), F.to_json(product_list_categories(values["product_list"].cast("string")))]
    custom = F.map_filter(F.create_map(*extras), lambda k, v: v.isNotNull()) if extras else F.lit(None).cast("map<string,string>")
    raw_time = frame[config.timestamp_field]
    is_text = isinstance(frame.schema[config.timestamp_field].dataType, T.StringType)
    out = frame.select(
        event_key(F.lit(config.table), frame[config.customer_id_field], raw_time, F.to_json(F.struct("*"))).alias("event_id"),
        frame[config.customer_id_field].cast("string").alias("customer_id"),
        F.lit(config.event_type).alias("event_type"),
        (parse_instant(raw_time) if is_text else raw_time.cast("timestamp")).alias("ts"),
        *[values.get(n, null).alias(n) for n in TARGETS],
        (first_present(*devices) if devices else null).alias("device_type"),
        F.when(F.size(custom) > 0, custom).alias("custom_properties"),
    )
    return out.where(non_empty(F.col("customer_id")).isNotNull() & F.col("ts").isNotNull())


def source_rows(
    frame: DataFrame, config: EventTable, start: str | None = None, end: str | None = None,
    sample_rate: float | None = None, seed: int = 42, limit: int | None = None,
) -> DataFrame:
    """Date range, extra predicates, seeded sampling, then order and limit; all of it pushes down."""
    rows = frame
    if start is not None:
        rows = rows.where(F.col(config.date_field) >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col(config.date_field) <= F.lit(end).cast("timestamp"))
    for predicate in config.filters:
        rows = rows.where(F.expr(predicate))
    if sample_rate is not None and sample_rate < 1.0:
        rows = rows.sample(fraction=sample_rate, seed=seed)
    if limit is not None:
        # maps, at any depth, have neither an order nor a hash, but a text
        plain = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
        texts = [F.to_json(F.struct(c)) for c in rows.columns if c not in plain]
        rows = rows.orderBy(config.timestamp_field, F.xxhash64(*plain, *texts), *plain, *texts).limit(limit)
    return rows
