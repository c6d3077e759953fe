"""Class names, severities and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The classes by number.
CLASSES = (
    "Benign",
    "Botnet Ares",
    "DDoS-HOIC",
    "DDoS-LOIC-HTTP",
    "DDoS-LOIC-UDP",
    "DoS GoldenEye",
    "DoS Hulk",
    "DoS Slowloris",
    "SSH-BruteForce",
)

#: The severity of each class.
SEVERITIES = {
    "Benign": "INFO",
    "SSH-BruteForce": "LOW",
    "DoS Slowloris": "MEDIUM",
    "Botnet Ares": "HIGH",
    "DoS GoldenEye": "HIGH",
    "DoS Hulk": "HIGH",
    "DDoS-LOIC-UDP": "CRITICAL",
    "DDoS-LOIC-HTTP": "CRITICAL",
    "DDoS-HOIC": "CRITICAL",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small table, null where it has none."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def class_label(class_id: Column, classes: tuple[str, ...] = CLASSES) -> Column:
    named = F.when((class_id >= 0) & (class_id < len(classes)), F.get(F.array(*map(F.lit, classes)), class_id.cast("int")))
    return F.coalesce(named, F.concat(F.lit("Class_"), class_id.cast("string")))


def class_number(label: Column, classes: tuple[str, ...] = CLASSES) -> Column:
    """The number of a class name; null, empty and unknown names are class 0."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, classes)), label), F.lit(0)) - 1, F.lit(0)).cast("int")


def severity(label: Column, class_id: Column, table: dict[str, str] | None = None) -> Column:
    """From the table; a class that it lacks is HIGH, or INFO if it is class 0."""
    return F.coalesce(lookup(SEVERITIES if table is None else table, label), F.when(class_id != 0, "HIGH").otherwise("INFO"))
