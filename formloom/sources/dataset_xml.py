"""Dataset definitions in XML: reading, writing, and links for publishing. Tags are case-sensitive."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from ..plans.publish import FieldMap, Link

#: What the attributes may be.
TYPES, DISCRIMINATORS, DISPLAY, ENTRY = ("SERVER", "CLIENT", "REPORT"), ("DATA", "CASES", "ENUMERATORS"), ("tree", "table"), ("LIST", "ENTRY", "SCAN")


@dataclass
class Dataset:
    id: str
    title: str
    type: str = "SERVER"
    discriminator: str = "DATA"
    columns: list[str] = field(default_factory=list)
    forms: list[str] = field(default_factory=list)
    links: list[dict[str, str]] = field(default_factory=list)
    cases: dict[str, object] = field(default_factory=dict)
    id_format: dict[str, str] = field(default_factory=dict)
    unique: str | None = None
    offline_updates: bool = False
    version: int = 1

    def problems(self) -> list[str]:
        out = [f"{name} is blank" for name in ("id", "title") if not getattr(self, name)]
        out += [f"{name} {value!r} is unknown" for name, value, known in (("datasetType", self.type, TYPES), ("discriminator", self.discriminator, DISCRIMINATORS)) if value not in known]
        if self.cases and self.cases.get("displayMode") not in DISPLAY:
            out.append("displayMode is tree or table")
        if self.cases.get("entryMode") and self.cases["entryMode"] not in ENTRY:
            out.append("entryMode is LIST, ENTRY or SCAN")
        if self.discriminator == "ENUMERATORS" and not self.id_format.get("numberOfDigits"):
            out.append("enumerators need numberOfDigits")
        for k, x in enumerate(self.links):
            out += [f"link {k + 1} has no {t}" for t in ("dataLinkClass", "dataLinkType", "linkObjectId") if not x.get(t)]
        return out

    def publish_links(self, key: str | None = None) -> list[Link]:
        """The links that bring form data in."""
        return [Link(
            x.get("joiningField", ""), key or self.unique or "id", FieldMap.of_json(x["fieldMap"]) if x.get("fieldMap") else [], x.get("relevanceField") or None,
            x.get("dataLinkState", "ENABLED") == "ENABLED", x.get("linkObjectId", ""), self.id, "INCOMING", x.get("dataLinkFormat", "0") == "0",
        ) for x in self.links if x.get("dataLinkType") == "INCOMING"]


def _text(el: ET.Element | None, tag: str) -> str | None:
    found = el.find(tag) if el is not None else None
    return (found.text or "").strip() if found is not None else None


def read(xml: str) -> Dataset:
    root = ET.fromstring(xml)
    d = root.find("definition")
    if root.tag != "dataset" or d is None:
        raise ValueError("a dataset has a definition")
    cases = {}
    if (c := d.find("caseManagementOptions")) is not None:
        cases = {x.tag: (x.text or "").strip() for x in c if x.tag != "showColumnsWhenTable"}
        cases["showColumnsWhenTable"] = [(x.text or "").strip() for x in c.iterfind("showColumnsWhenTable/columnNames")]
    return Dataset(
        _text(d, "id") or "", _text(d, "title") or "", _text(d, "datasetType") or "SERVER", _text(d, "discriminator") or "DATA",
        [x.strip() for x in (_text(d, "fieldNames") or "").split(",") if x.strip()], [(x.text or "").strip() for x in d.iterfind("formLinks/formLink/formId")],
        [{x.tag: (x.text or "").strip() for x in link} for link in d.iterfind("dataLinks/dataLink")], cases, {x.tag: (x.text or "").strip() for x in d.iterfind("idFormatOptions/*")},
        _text(d, "uniqueRecordField") or None, _text(d, "allowOfflineUpdates") == "true", int(_text(root.find("instance"), "version") or 1),
    )


def write(ds: Dataset) -> str:
    root = ET.Element("dataset")
    d = ET.SubElement(root, "definition")

    def put(parent: ET.Element, tag: str, text: object) -> ET.Element:
        el = ET.SubElement(parent, tag)
        el.text = None if text is None else str(text)
        return el

    for tag, value in (("id", ds.id), ("title", ds.title), ("datasetType", ds.type), ("fieldNames", ",".join(ds.columns))):
        put(d, tag, value)
    forms = ET.SubElement(d, "formLinks")
    for f in ds.forms:
        put(ET.SubElement(forms, "formLink"), "formId", f)
    links = ET.SubElement(d, "dataLinks")
    for x in ds.links:
        el = ET.SubElement(links, "dataLink")
        for tag, value in x.items():
            put(el, tag, value)
    if ds.cases:
        c = ET.SubElement(d, "caseManagementOptions")
        for tag, value in ds.cases.items():
            if isinstance(value, list):
                box = ET.SubElement(c, tag)
                for v in value:
                    put(box, "columnNames", v)
            else:
                put(c, tag, value)
    if ds.id_format:
        f = ET.SubElement(d, "idFormatOptions")
        for tag, value in ds.id_format.items():
            put(f, tag, value)
    put(d, "discriminator", ds.discriminator)
    if ds.unique:
        put(d, "uniqueRecordField", ds.unique)
    put(d, "allowOfflineUpdates", str(ds.offline_updates).lower())
    put(ET.SubElement(root, "instance"), "version", ds.version)
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


class Catalog:
    """Datasets known to forms: which form may read which, and their versions."""

    def __init__(self):
        self.datasets: dict[str, Dataset] = {}

    def upload(self, ds: Dataset) -> None:
        ds.version = 1  # an upload begins anew
        self.datasets[ds.id] = ds

    def readable(self, form_id: str) -> list[str]:
        return sorted(k for k, d in self.datasets.items() if form_id in d.forms)
