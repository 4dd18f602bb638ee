"""Entities from object-model XML: attributes, as-of attributes and relationships of one object a document.

Read are PackageName, ClassName, DefaultTable, Attribute, AsOfAttribute and Relationship. Refused: document type
declarations, objects that are pure or temporary, source attributes, identity columns, null for infinity, nullable keys.
"""

from __future__ import annotations

import datetime as dt
import re
import xml.etree.ElementTree as ET

from palimpsest.model import INFINITY, Attribute, Axis, Entity, ModelError, Relationship, spark_type

#: Type names of the format.
_TYPES = {"boolean": "boolean", "byte": "byte", "short": "short", "int": "int", "long": "long", "float": "float", "double": "double", "char": "char", "String": "string", "Date": "date", "Timestamp": "timestamp", "Time": "time", "BigDecimal": "decimal", "byte[]": "bytes"}
_KINDS = ("processingDate", "businessDate")


def _true(node: ET.Element, name: str) -> bool:
    return node.get(name, "false").strip().lower() == "true"


def _text(root: ET.Element, name: str) -> str | None:
    node = root.find(name)
    return node.text.strip() if node is not None and node.text else None


def _attribute(node: ET.Element) -> Attribute:
    name, kind = node.get("name"), node.get("javaType")
    if not name or kind not in _TYPES:
        raise ModelError("CFG-001", f"attribute {name}: type {kind}")
    if _true(node, "identity"):
        raise ModelError("CFG-004", f"attribute {name}: identity columns are not supported")
    key, nullable = _true(node, "primaryKey"), node.get("nullable", "true").lower() != "false"
    if key and node.get("nullable", "").lower() == "true":
        raise ModelError("CFG-001", f"attribute {name}: a key cannot be null")
    precision, scale = (int(node.get(x)) if node.get(x) else None for x in ("precision", "scale"))
    return Attribute(name, spark_type(_TYPES[kind], precision, scale), key, nullable and not key, node.get("columnName"))


def _axis(node: ET.Element) -> Axis:
    name = node.get("name")
    if _true(node, "infinityIsNull"):
        raise ModelError("CFG-003", f"{name}: null for infinity is not supported")
    given = node.get("infinityDate", "")
    m = re.search(r"(\d{4})-(\d{2})-(\d{2}) (\d{2}):(\d{2})(?::(\d{2}))?", given)
    infinity = dt.datetime(*(int(x or 0) for x in m.groups())) if m else INFINITY
    default = infinity if "infinity" in node.get("defaultIfNotSpecified", "").lower() or node.get("defaultIfNotSpecified") == given != "" else None
    if not node.get("fromColumnName") or not node.get("toColumnName"):
        raise ModelError("CFG-001", f"{name}: boundary columns are missing")
    return Axis(name, node.get("fromColumnName"), node.get("toColumnName"), infinity, _true(node, "toIsInclusive"), default, node.get("futureExpiringRowsExist", "true").lower() != "false")


_TIE = re.compile(r"^this\.(\w+)\s*=\s*(?:\w+)\.(\w+)$")


def _relationship(node: ET.Element) -> Relationship:
    on = []
    for part in re.split(r"\s+and\s+", " ".join((node.text or "").split())):
        m = _TIE.match(part)
        if not m:
            raise ModelError("CFG-005", f"relationship {node.get('name')}: {part!r} is no equality")
        on.append(m.groups())
    return Relationship(node.get("name"), node.get("relatedObject"), tuple(on), node.get("cardinality", "one-to-many").endswith("many"), node.get("reverseRelationshipName"))


def parse(text: str) -> Entity:
    """One entity from its XML."""
    if re.search(r"<!\s*(DOCTYPE|ENTITY)", text, re.I):
        raise ModelError("CFG-001", "document type declarations are refused")
    try:
        root = ET.fromstring(text)
    except ET.ParseError as x:
        raise ModelError("CFG-001", f"not well-formed: {x}") from x
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2]
    if not root.tag.endswith("Object") or root.tag.endswith(("PureObject", "TempObject")):
        raise ModelError("CFG-002", f"{root.tag} objects are not supported")
    if root.find("SourceAttribute") is not None:
        raise ModelError("CFG-012", "source attributes are not supported")
    axes = [_axis(n) for n in root.findall("AsOfAttribute")]
    processing = next((a for n, a in zip(root.findall("AsOfAttribute"), axes, strict=True) if _true(n, "isProcessingDate") or a.name == _KINDS[0]), None)
    business = next((a for a in axes if a is not processing), None)
    if len(axes) > 2 or (len(axes) == 2 and processing is None):
        raise ModelError("CFG-015", "at most a business and a processing axis")
    attributes = [_attribute(n) for n in root.findall("Attribute")]
    kept = {c for a in axes for c in (a.start, a.end)}
    attributes = [a for a in attributes if a.stored not in kept]
    return Entity(_text(root, "ClassName") or "", tuple(attributes), business, processing, tuple(_relationship(n) for n in root.findall("Relationship")), _text(root, "DefaultTable"))
