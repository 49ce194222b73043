"""Standard XLSForms and their extended dialect (matrix, score, rank) to the engine's forms."""

from __future__ import annotations

import json
import re

from ..operators.form import canonical_header
from ..sources.dataset_xml import Dataset
from .common import DROPPED, FULL, LOSSY, PARTIAL, Converted, expression, hint_text, label_text, range_constraint, safe_name, safe_names

_SLOTS = {"relevance": True, "constraint": True, "calculation": False, "choice_filter": True, "repeat_count": False}
#: Settings that are carried over, and those that go (with what to say).
KEPT_SETTINGS = ("form_title", "form_id", "default_language", "instance_name")
GONE_SETTINGS = {"style": "choose the style when deploying", "public_key": "set encryption anew", "submission_url": "submissions go to the server the form is on", "auto_send": "set on the device", "auto_delete": "set on the device", "allow_choice_duplicates": "give choices values of their own"}
#: Appearances of other names.
APPEARANCES = {"minimal": "minimal", "columns-pack": "compact", "columns": "compact", "horizontal": "compact", "horizontal-compact": "compact", "likert": "likert", "numbers": "numbers", "search": "minimal", "autocomplete": "minimal"}
GONE_APPEARANCES = {"printer": "printing has no equivalent", "pages": "groups with field-list make pages", "theme-grid": "there is no grid theme"}


def convert(survey: list[dict], choices: list[dict], settings: dict | None = None, lookups: set[str] = frozenset()) -> Converted:
    """lookups: names of attached data that take the place of choices from files."""
    out = Converted()
    head = lambda rows: [{_header(k): v for k, v in r.items() if v not in (None, "")} for r in rows]
    survey, choices, settings = head(survey), head(choices), head([settings or {}])[0]
    names = safe_names([r["name"] for r in survey if r.get("name") and not re.match(r"end[ _]", r.get("type", ""))], out.note)
    out.choices = [{**{k: v for k, v in c.items() if k != "name"}, "value": str(c.get("value", c.get("name")))} for c in choices]
    matrix: list[str] = []
    for r in survey:
        kind = re.sub(r"^(begin|end)_", r"\1 ", r.get("type", "").strip())
        row = {k: v for k, v in r.items() if k not in ("parameters", "kobo--matrix_list", "kobo--score-choices")} | {"type": kind}
        if row.get("name"):
            row["name"] = names.get(row["name"], row["name"])
        name = row.get("name", kind)
        for slot, boolean in _SLOTS.items():
            if row.get(slot):
                row[slot] = _renamed(expression(row[slot], out, name, boolean), names)
        for c in row:
            if c.startswith("label"):
                row[c] = _renamed(label_text(row[c]), names)
            elif c.startswith("hint"):
                row[c] = _renamed(hint_text(row[c]), names)
        _appearance(row, out, name)
        rows, status, why = _row(row, r, matrix, out, lookups)
        out.survey += rows
        if not kind.startswith("end "):
            out.note(name, status, why)
    _settings(settings, out)
    return out


def _header(name: str) -> str:
    return re.sub(r"\s*\([a-z]{2,3}\)$", lambda m: m[0], canonical_header(name))


def language_name(name: str) -> str:
    """A language without its locale tag: English (en) is English."""
    return re.sub(r"\s*\([A-Za-z_-]{2,8}\)\s*$", "", name)


def _renamed(text: str | None, names: dict[str, str]) -> str | None:
    return text and re.sub(r"\$\{\s*([^}]+?)\s*\}", lambda m: "${" + names.get(m[1], m[1]) + "}", text)


def _appearance(row: dict, out: Converted, name: str) -> None:
    words = []
    for w in re.findall(r"[\w-]+\([^)]*\)|\S+", row.get("appearance", "")):
        if w in GONE_APPEARANCES:
            out.note(name, PARTIAL, f"appearance {w} dropped: {GONE_APPEARANCES[w]}")
        else:
            words.append(APPEARANCES.get(w, w))
    if words:
        row["appearance"] = " ".join(words)
    else:
        row.pop("appearance", None)


def _parameters(text: str | None) -> dict[str, str]:
    return dict(p.split("=", 1) for p in re.split(r"[;,\s]+", text or "") if "=" in p)


def _row(row: dict, source: dict, matrix: list[str], out: Converted, lookups: set[str]) -> tuple[list[dict], str, str]:
    kind, name = row["type"], row.get("name", "")
    if kind == "range":
        p = _parameters(source.get("parameters"))
        whole = not any("." in p.get(k, "") for k in ("start", "end", "step"))
        bounds = range_constraint(p.get("start"), p.get("end"))
        own = row.get("constraint")
        return [row | {"type": "integer" if whole else "decimal", "constraint": f"({own}) and {bounds}" if own else bounds}], FULL, "range as a number with bounds"
    if m := re.match(r"select_(one|multiple)_from_file\s+(\S+)", kind):
        stem = m[2].rsplit(".", 1)[0]
        if stem not in lookups:
            out.note("survey", PARTIAL, f"attach {m[2]} as data {stem}")
        p = _parameters(source.get("parameters"))
        out.choices.append({"list_name": stem, "value": p.get("value", "name"), "label": p.get("label", "label")})
        return [row | {"type": f"select_{m[1]} {stem}", "appearance": " ".join(x for x in (row.get("appearance"), f"search('{stem}')") if x)}], PARTIAL, f"choices come from {stem} by search()"
    if kind in ("csv-external", "xml-external"):
        out.note("survey", PARTIAL, f"attach {name}.csv to the form" if kind[0] == "c" else f"publish {name} as a dataset")
        return [], DROPPED, "attached data needs no row"
    if kind == "background-audio":
        return [{"type": "note", "name": name, "label": "Background recording"}], LOSSY, "use an audio audit instead"
    if kind in ("begin rank", "rank") or kind.startswith("rank "):
        return [{**row, "type": "note"}], LOSSY, "ranking has no equivalent; design it by hand"
    if kind == "end rank":
        return [], DROPPED, ""
    if kind in ("begin kobomatrix", "begin matrix"):
        matrix.append(source.get("kobo--matrix_list", ""))
        return [row | {"type": "begin group", "appearance": "field-list"}], FULL, "matrix as a group on one screen"
    if kind in ("end kobomatrix", "end matrix"):
        matrix.pop()
        return [row | {"type": "end group"}], FULL, ""
    if matrix and kind.startswith("select_"):
        rows = [c for c in out.choices if c["list_name"] == matrix[-1]]
        return [{**row, "name": f"{c['value']}_{name}", "label": f"{c.get('label', '')}: {row.get('label', '')}"} for c in rows], FULL, f"{len(rows)} rows of a matrix"
    if kind in ("begin score", "end score"):
        return [row | {"type": kind.replace("score", "group")} | ({"appearance": "field-list"} if kind[0] == "b" else {})], FULL, ""
    if kind == "score__row":
        return [row | {"type": f"select_one {source.get('kobo--score-choices', 'score')}", "appearance": "likert"}], FULL, ""
    if kind == "integer" and re.search(r"<=?\s*\d{10,}", row.get("constraint", "")):
        return [row | {"type": "text", "appearance": "numbers"}], PARTIAL, "more than nine digits: a text of digits"
    if kind in ("today", "email", "acknowledge", "audit"):
        return [row], PARTIAL, f"{kind} is accepted, but not documented"
    return [row], FULL, ""


def _settings(settings: dict, out: Converted) -> None:
    for k, v in settings.items():
        if k in KEPT_SETTINGS:
            out.settings[k] = language_name(v) if k == "default_language" else v
        elif k in GONE_SETTINGS:
            out.note("survey", PARTIAL, f"setting {k} dropped: {GONE_SETTINGS[k]}")
    default = out.settings.get("default_language")
    suffixes = {c.split(":", 1)[1] for r in out.survey for c in r if c.startswith("label:")}
    whole = next((s for s in suffixes if default and language_name(s) == default), None)
    for rows in (out.survey, out.choices):
        for r in rows:
            for c in [c for c in r if ":" in c and c.split(":")[0] in ("label", "hint", "constraint message", "required message")]:
                stem, lang = c.split(":", 1)
                to = stem if lang == whole else f"{stem}:{language_name(lang)}"
                if to != c:
                    r[to] = r.pop(c)


def entities(declared: list[dict], survey: list[dict], out: Converted, form_id: str) -> list[Dataset]:
    """Entity declarations as datasets that the form publishes into.

    Fields with save_to become columns; create_if becomes a calculated gate
    (1 publishes), which is appended to the converted survey.
    """
    made = []
    for e in declared:
        name = e.get("list_name") or e.get("dataset")
        if not name:
            continue
        saved = {r["name"]: r["save_to"] for r in survey if r.get("save_to") and r.get("name")}
        names = safe_names(list(saved), out.note)
        key = re.sub(r"\W", "", str(e.get("entity_id") or "")) or f"{name}_id"
        if not e.get("entity_id"):
            out.survey.append({"type": "calculate", "name": key, "calculation": "once(uuid())"})
        link = {"dataLinkClass": "FORM", "dataLinkType": "INCOMING", "linkObjectId": form_id, "joiningField": key, "fieldMap": json.dumps([{"formField": names[f], "datasetField": c, "updateLogicAction": "REPLACE", "updateLogicOptions": None} for f, c in saved.items()])}
        if e.get("create_if"):
            gate = f"publish_{safe_name(name)}"
            out.survey.append({"type": "calculate", "name": gate, "calculation": f"if({expression(e['create_if'], out, gate, True)}, 1, 0)"})
            link["relevanceField"] = gate
        made.append(Dataset(name, e.get("label") or name, columns=["id", *saved.values()], forms=[form_id], links=[link], unique="id"))
        out.note("survey", PARTIAL, f"entity list {name} is a dataset now: upload it before the form")
    return made
