"""RDF/XML and JSON-LD (expanded and compacted with inline contexts), to the same triples."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from urllib.parse import urljoin

from oriel import terms as t
from oriel.sources.turtle import ParseError, blank_id

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + t.RDF + "}"


def parse_xml(text: str, scope: str = "", base: str = "") -> tuple[list[tuple], dict[str, str]]:
    out: list[tuple] = []
    prefixes: dict[str, str] = {}
    fresh = iter(range(10**9))
    try:
        for event, ns in ET.iterparse(__import__("io").StringIO(text), ["start-ns"]):
            prefixes.setdefault(ns[0], ns[1])
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ParseError(str(e)) from e
    name = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag
    new = lambda: (blank_id(scope, f"\x01{next(fresh)}"), t.BLANK)

    def node(e, base, lang):
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        if e.get(_R + "about") is not None:
            s = (urljoin(base, e.get(_R + "about")), t.IRI)
        elif e.get(_R + "ID") is not None:
            s = (urljoin(base, "#" + e.get(_R + "ID")), t.IRI)
        elif e.get(_R + "nodeID") is not None:
            s = (blank_id(scope, e.get(_R + "nodeID")), t.BLANK)
        else:
            s = new()
        if e.tag != _R + "Description":
            out.append((*s, t.TYPE, name(e.tag), t.IRI, None, None))
        for key, value in e.attrib.items():
            if not key.startswith(_XML) and key not in (_R + "about", _R + "ID", _R + "nodeID"):
                if key == _R + "type":
                    out.append((*s, t.TYPE, urljoin(base, value), t.IRI, None, None))
                else:
                    out.append((*s, name(key), value, t.LITERAL, t.RDF + "langString" if lang else t.XSD + "string", lang))
        position = 0
        for child in e:
            p = name(child.tag)
            if child.tag == _R + "li":
                position += 1
                p = f"{t.RDF}_{position}"
            prop(s, p, child, base, lang)
        return s

    def prop(s, p, e, base, lang):
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        kind = e.get(_R + "parseType")
        if e.get(_R + "resource") is not None:
            o = (urljoin(base, e.get(_R + "resource")), t.IRI, None, None)
        elif e.get(_R + "nodeID") is not None:
            o = (blank_id(scope, e.get(_R + "nodeID")), t.BLANK, None, None)
        elif kind == "Resource":
            inner = new()
            for child in e:
                prop(inner, name(child.tag), child, base, lang)
            o = (*inner, None, None)
        elif kind == "Collection":
            items = [node(c, base, lang) for c in e]
            cells = [new() for _ in items]
            for i, (cell, item) in enumerate(zip(cells, items, strict=True)):
                out.append((*cell, t.RDF + "first", *item, None, None))
                out.append((*cell, t.RDF + "rest", *(cells[i + 1] if i + 1 < len(cells) else (t.RDF + "nil", t.IRI)), None, None))
            o = (*(cells[0] if cells else (t.RDF + "nil", t.IRI)), None, None)
        elif kind == "Literal":
            o = ((e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e), t.LITERAL, t.RDF + "XMLLiteral", None)
        elif len(e):
            o = (*node(e[0], base, lang), None, None)
        elif any(not k.startswith(_XML) and not k.startswith(_R) for k in e.attrib):
            inner = new()
            for k, v in e.attrib.items():
                if not k.startswith(_XML) and not k.startswith(_R):
                    out.append((*inner, name(k), v, t.LITERAL, t.RDF + "langString" if lang else t.XSD + "string", lang))
            o = (*inner, None, None)
        else:
            dt = e.get(_R + "datatype")
            o = (e.text or "", t.LITERAL, dt or (t.RDF + "langString" if lang else t.XSD + "string"), None if dt else lang)
        out.append((*s, p, *o))

    if root.tag == _R + "RDF":
        for child in root:
            node(child, root.get(_XML + "base", base), root.get(_XML + "lang"))
    else:
        node(root, base, None)
    return out, prefixes


def parse_json(text: str, scope: str = "", base: str = "") -> tuple[list[tuple], dict[str, str]]:
    try:
        doc = json.loads(text)
    except json.JSONDecodeError as e:
        raise ParseError(str(e)) from e
    out: list[tuple] = []
    prefixes: dict[str, str] = {}
    fresh = iter(range(10**9))

    def merge(context: dict, more) -> dict:
        for c in more if isinstance(more, list) else [more]:
            if isinstance(c, dict):
                context = {**context, **c}
                prefixes.update({k: v for k, v in c.items() if isinstance(v, str) and not k.startswith("@") and v[-1:] in "#/:"})
        return context

    def expand(value: str, context: dict, vocab: bool) -> str:
        known = context.get(value) if vocab else None
        if isinstance(known, dict):
            known = known.get("@id")
        if known and known != value:
            return expand(known, context, True)
        if value.startswith(("@", "_:")):
            return value
        head, colon, tail = value.partition(":")
        if colon and not tail.startswith("//") and isinstance(context.get(head), str):
            return expand(context[head], context, False) + tail
        if colon:
            return value
        return (context.get("@vocab", "") + value) if vocab else urljoin(context.get("@base", base), value)

    def ref(value: str, context: dict, vocab: bool = False) -> tuple[str, int]:
        full = expand(value, context, vocab)
        return (blank_id(scope, full[2:]), t.BLANK) if full.startswith("_:") else (full, t.IRI)

    def values(s, p, v, context, term):
        kind = term.get("@type") if isinstance(term, dict) else None
        box = term.get("@container") if isinstance(term, dict) else None
        if isinstance(v, dict) and "@list" in v or box == "@list":
            items = v["@list"] if isinstance(v, dict) else v if isinstance(v, list) else [v]
            cells = [(blank_id(scope, f"\x01{next(fresh)}"), t.BLANK) for _ in items]
            for i, (cell, item) in enumerate(zip(cells, items, strict=True)):
                values(cell, t.RDF + "first", item, context, {"@type": kind} if kind else {})
                out.append((*cell, t.RDF + "rest", *(cells[i + 1] if i + 1 < len(cells) else (t.RDF + "nil", t.IRI)), None, None))
            out.append((*s, p, *(cells[0] if cells else (t.RDF + "nil", t.IRI)), None, None))
        elif isinstance(v, list):
            for x in v:
                values(s, p, x, context, term)
        elif isinstance(v, dict) and "@value" in v:
            literal(s, p, v["@value"], v.get("@language"), v.get("@type") and expand(v["@type"], context, True))
        elif isinstance(v, dict):
            out.append((*s, p, *node(v, context), None, None))
        elif v is not None and kind in ("@id", "@vocab") and isinstance(v, str):
            out.append((*s, p, *ref(v, context, kind == "@vocab"), None, None))
        elif v is not None:
            lang = term.get("@language", context.get("@language")) if isinstance(term, dict) else context.get("@language")
            literal(s, p, v, lang if isinstance(v, str) and not kind else None, kind and expand(kind, context, True))

    def literal(s, p, v, lang, dt):
        if isinstance(v, bool):
            v, dt = str(v).lower(), dt or t.XSD + "boolean"
        elif isinstance(v, int):
            v, dt = str(v), dt or t.XSD + "integer"
        elif isinstance(v, float):
            v, dt = repr(v), dt or t.XSD + "double"
        out.append((*s, p, v, t.LITERAL, t.RDF + "langString" if lang else dt or t.XSD + "string", lang))

    def node(d: dict, context: dict) -> tuple[str, int]:
        context = merge(context, d.get("@context", {}))
        own = next((d[k] for k in d if expand(k, context, True) == "@id"), None)
        s = ref(own, context) if own is not None else (blank_id(scope, f"\x01{next(fresh)}"), t.BLANK)
        for key, v in d.items():
            p = expand(key, context, True)
            if p == "@type":
                for c in v if isinstance(v, list) else [v]:
                    out.append((*s, t.TYPE, *ref(c, context, True), None, None))
            elif p == "@graph":
                for x in v if isinstance(v, list) else [v]:
                    node(x, context)
            elif p == "@reverse":
                for q, xs in v.items():
                    for x in xs if isinstance(xs, list) else [xs]:
                        out.append((*node(x, context), expand(q, context, True), *s, None, None))
            elif not p.startswith("@") and ":" in p:
                values(s, p, v, context, context.get(key) if isinstance(context.get(key), dict) else {})
        return s

    for d in doc if isinstance(doc, list) else [doc]:
        node(d, {})
    return out, prefixes
