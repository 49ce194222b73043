"""Parsed XForms to the engine's forms."""

from __future__ import annotations

import re

from ..expressions.syntax import Call, Literal, parse, print_expr, transform
from ..sources.xforms import XForm, leaf_of
from .common import FULL, LOSSY, PARTIAL, Converted, expression, hint_text, label_text, range_constraint, safe_name, shared_lists, suffixed

#: Target types by the schema type of the bind.
INPUTS = {"string": "text", "int": "integer", "integer": "integer", "decimal": "decimal", "double": "decimal", "date": "date", "datetime": "datetime", "time": "time", "geopoint": "geopoint", "barcode": "barcode", "": "text"}
PRELOADS = {("timestamp", "start"): "start", ("timestamp", "end"): "end", ("date", "today"): "today", ("property", "deviceid"): "deviceid", ("property", "username"): "username", ("property", "phonenum"): "phonenumber"}
NO_EQUIVALENT = ("if-not-changed", "commcare-version", "weeks-since", "count-related-cases")


def convert(form: XForm, dataset: str = "cases", language_names: dict[str, str] | None = None) -> Converted:
    out = Converted(settings={"form_title": form.title, "form_id": re.sub(r"^[^A-Za-z]+", "", re.sub(r"[^A-Za-z0-9_-]+", "_", form.form_id)).lower() or "form"})
    names = language_names or {}
    default = form.languages[0] if form.languages else ""
    if default:
        out.settings["default_language"] = names.get(default, default)
    paths = field_names(form, out)
    lists: dict[str, list[dict]] = {}
    for q in [*form.hidden, *form.questions]:
        name = paths.get(q["nodeset"], safe_name(q["name"]) if q["name"] else "")
        if q["type"].startswith(("begin_", "end_")):
            row = {"type": q["type"].replace("_", " "), "name": name or f"group_{q.get('seq', 0)}"}
            if q["type"].startswith("end_"):
                row["name"] = next((r["name"] for r in reversed(_open(out.survey)) ), row["name"])
        else:
            row = _control(q, name, lists, default, names, out)
        if row is None:
            continue
        row |= suffixed({k: label_text(v) for k, v in (q.get("labels") or {}).items()}, "label", default, names)
        row |= suffixed({k: hint_text(v) for k, v in (q.get("hints") or {}).items()}, "hint", default, names)
        row |= suffixed(q.get("constraint_message") or {}, "constraint message", default, names) | suffixed(q.get("required_message") or {}, "required message", default, names)
        for kind, texts in (q.get("media") or {}).items():
            row |= suffixed({k: v.rsplit("/", 1)[-1] for k, v in texts.items()}, f"media:{kind}", default, names)
        for source, slot, boolean in (("relevant", "relevance", True), ("constraint", "constraint", True), ("calculate", "calculation", False), ("repeat_count", "repeat_count", False)):
            if q.get(source):
                row[slot] = _cases(expression(q[source], out, name, boolean, paths), dataset, out, name)
        if q.get("required"):
            row["required"] = "yes"
        if q.get("readonly"):
            row["read only"] = "yes"
        out.survey.append(row)
        if not q["type"].startswith("end_"):
            out.note(name, FULL)
    shared, kept = shared_lists(lists)
    for r in out.survey:
        if (m := re.match(r"(select_\w+) (\S+)", r["type"])) and m[2] in shared:
            r["type"] = f"{m[1]} {shared[m[2]]}"
    out.choices = [{"list_name": n, **c} for n, rows in kept.items() for c in rows]
    for a in form.case_actions:
        out.note("survey", LOSSY, f"case action {a['action']}: publish to the dataset {dataset} instead")
    for w in form.warnings:
        out.note("survey", PARTIAL, w)
    return out


def _open(rows: list[dict]) -> list[dict]:
    held: list[dict] = []
    for r in rows:
        if r["type"].startswith("begin "):
            held.append(r)
        elif r["type"].startswith("end "):
            held.pop()
    return held


def field_names(form: XForm, out: Converted) -> dict[str, str]:
    """Full path: field name; leaves that meet are told apart by their groups, then by numbers."""
    names, used = {}, {}
    for q in [*form.hidden, *form.questions]:
        if q["type"].startswith("end_") or not q["name"] or q["nodeset"] in names:
            continue
        base = safe_name(q.get("suggested_safe_name") or q["name"])
        used[base] = used.get(base, 0) + 1
        names[q["nodeset"]] = base if used[base] == 1 else f"{base}_{used[base]}"
        if q.get("suggested_safe_name"):
            out.note(q["name"], PARTIAL, f"renamed {names[q['nodeset']]}: the name occurs more than once")
    return names


def _control(q: dict, name: str, lists: dict, default: str, names: dict, out: Converted) -> dict | None:
    kind, schema = q["type"], (q.get("xforms_type") or "").rpartition(":")[2].lower()
    row = {"name": name} | ({"appearance": q["appearance"]} if q.get("appearance") else {})
    if q.get("preload"):
        target = PRELOADS.get((q["preload"], (q.get("preload_params") or "").lower())) or ("caseid" if q["preload"] == "case" else None)
        if target is None:
            out.note(name, LOSSY, f"preload {q['preload']} has no equivalent")
            return None
        return row | {"type": target}
    if kind == "hidden":
        return row | {"type": "calculate"}
    if kind == "input":
        return row | {"type": INPUTS.get(schema, "text")}
    if kind in ("select", "select1"):
        if q.get("itemset"):
            out.note(name, PARTIAL, f"choices come from {q['itemset']}; attach them as data")
        lists[name] = [{"value": i["value"], **suffixed(i["labels"], "label", default, names)} for i in q.get("choices") or []]
        return row | {"type": f"select_{'one' if kind == 'select1' else 'multiple'} {name}"}
    if kind == "upload":
        return row | {"type": (q.get("upload_mediatype") or "file/*").split("/")[0].replace("application", "file").replace("*", "file")}
    if kind == "trigger":
        return row | {"type": "acknowledge"}
    if kind == "range":
        p = q.get("parameters") or {}
        return row | {"type": "decimal" if any("." in v for v in p.values()) or schema in ("decimal", "double") else "integer", "constraint": range_constraint(p.get("start"), p.get("end"))}
    out.note(name, PARTIAL, "shown as it is typed: there is no secret text")
    return row | {"type": "text"}


_CASE_READ = re.compile(r"instance\(\s*'casedb'\s*\)/casedb/case\[\s*@case_id\s*=\s*([^\]]+?)\s*\]/(\w+)")


def _cases(text: str | None, dataset: str, out: Converted, item: str) -> str | None:
    """Reads of the case database as pulldata(), and functions without an equivalent taken out."""
    if not text:
        return text
    text = _CASE_READ.sub(lambda m: f"pulldata('{dataset}', '{m[2]}', 'id', {'${' + leaf_of(m[1]) + '}' if '/' in m[1] and '(' not in m[1] else m[1]})", text)
    if any(f in text for f in NO_EQUIVALENT):
        out.note(item, LOSSY, f"no equivalent: {text}")
        return print_expr(transform(parse(text), lambda e: Literal("") if isinstance(e, Call) and e.name in NO_EQUIVALENT else e)) if "instance(" not in text else ""
    if "instance(" in text:
        out.note(item, LOSSY, f"reads another instance: {text}")
    return text


__all__ = ["convert", "field_names"]
