"""A Turtle and N-Triples parser: one regular-expression scanner, one loop with an explicit stack."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import urljoin

from oriel import terms as t

_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_NAME = r"[\w·À-￿-]"
_TOKEN = re.compile(
    r"""(?P<skip>(?:\s+|\#[^\n]*)+)
    |<(?P<iri>[^<>"{}|^`\x00-\x20]*)>
    |(?P<long>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3})
    |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |_:(?P<blank>[\w](?:[\w.·-]*[\w·-])?)
    |@(?P<at>[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<pname>(?:[^\W\d_](?:[\w.·-]*[\w·-])?)?:(?:(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>\^\^|[.;,()\[\]{}])""",
    re.X | re.S,
)


class ParseError(ValueError):
    pass


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


def blank_id(scope: str, label: str) -> str:
    """An identifier of letters and digits alone, the same in every run, apart in every file."""
    return "b" + hashlib.md5(f"{scope}\x00{label}".encode()).hexdigest()[:16]


def parse(text: str, scope: str = "", base: str = "") -> tuple[list[tuple], dict[str, str]]:
    """Triples (s, s_kind, p, o, o_kind, datatype, language) and prefixes of a Turtle document."""
    tokens = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at : at + 20]!r}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m.group(m.lastgroup), at))
        at = m.end()
    prefixes: dict[str, str] = {}
    out: list[tuple] = []
    fresh = 0
    i = 0

    def fail(why: str):
        where = tokens[min(i, len(tokens) - 1)][2] if tokens else 0
        raise ParseError(f"line {text.count(chr(10), 0, where) + 1}: {why}")

    def peek():
        return tokens[i][:2] if i < len(tokens) else ("end", "")

    def take(kind=None, value=None):
        nonlocal i
        k, v = peek()
        if k == "end" or kind and k != kind or value is not None and v != value:
            fail(f"expected {value or kind}, found {v!r}")
        i += 1
        return k, v

    def blank() -> tuple[str, int]:
        nonlocal fresh
        fresh += 1
        return blank_id(scope, f"\x01{fresh}"), t.BLANK

    def iri(k: str, v: str) -> str:
        if k == "iri":
            v = unescape(v)
            return urljoin(base, v) if base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", v) else v
        if k != "pname":
            fail(f"expected an IRI, found {v!r}")
        prefix, _, local = v.partition(":")
        if prefix not in prefixes:
            fail(f"prefix {prefix!r} is not declared")
        return prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def emit(s, p, o):
        out.append((*s, p, *o) if len(o) == 4 else (*s, p, *o, None, None))

    def literal(k: str, v: str) -> tuple:
        nonlocal i
        if k == "num":
            kind = "double" if "e" in v.lower() else "decimal" if "." in v else "integer"
            return v, t.LITERAL, t.XSD + kind, None
        v = unescape(v[3:-3] if k == "long" else v[1:-1])
        k2, v2 = peek()
        if k2 == "at":
            i += 1
            return v, t.LITERAL, t.RDF + "langString", v2.lower()
        if (k2, v2) == ("mark", "^^"):
            i += 1
            return v, t.LITERAL, iri(*take()), None
        return v, t.LITERAL, t.XSD + "string", None

    # Each frame: [kind, subject, predicate]. "stmt" and "[" hold predicate lists, "(" a collection.
    stack: list[list] = []

    def node(subject_place: bool):
        """A term, or None after opening a bracket whose end will give it."""
        nonlocal i
        k, v = take()
        if k in ("iri", "pname"):
            return iri(k, v), t.IRI
        if k == "blank":
            return blank_id(scope, v), t.BLANK
        if (k, v) == ("mark", "["):
            own = blank()
            if peek() == ("mark", "]"):
                i += 1
                return own
            stack.append(["[", own, None])
            return None
        if (k, v) == ("mark", "("):
            if peek() == ("mark", ")"):
                i += 1
                return t.RDF + "nil", t.IRI
            head = blank()
            stack.append(["(", head, head, True])
            return None
        if not subject_place:
            if k in ("str", "long", "num"):
                return literal(k, v)
            if k == "word" and v in ("true", "false"):
                return v, t.LITERAL, t.XSD + "boolean", None
        fail(f"expected a term, found {v!r}")

    def verb():
        k, v = take()
        return t.TYPE if (k, v) == ("word", "a") else iri(k, v)

    done = None  # a finished bracket's term, to be used by the frame below
    while i < len(tokens) or stack:
        if not stack:
            k, v = peek()
            if k == "at" and v in ("prefix", "base") or k == "word" and v.lower() in ("prefix", "base"):
                i += 1
                if v.lower() == "prefix":
                    name = take("pname")[1]
                    if not name.endswith(":"):
                        fail("a prefix ends with a colon")
                    prefixes[name[:-1]] = iri(*take("iri"))
                else:
                    base = iri(*take("iri"))
                if k == "at":
                    take("mark", ".")
                continue
            stack.append(["stmt", None, None])
            done = node(True)
            continue
        frame = stack[-1]
        if frame[0] == "(":
            if done is None and peek() != ("mark", ")"):
                done = node(False)
                if done is None:
                    continue
            if done is not None:
                if not frame[3]:
                    more = blank()
                    emit(frame[2], t.RDF + "rest", more)
                    frame[2] = more
                frame[3] = False
                emit(frame[2], t.RDF + "first", done)
                done = None
                continue
            take("mark", ")")
            emit(frame[2], t.RDF + "rest", (t.RDF + "nil", t.IRI))
            stack.pop()
            done = frame[1]
            continue
        if frame[0] == "stmt" and frame[1] is None:
            frame[1], done = done, None
            if peek() == ("mark", "."):  # a bracket alone
                i += 1
                stack.pop()
                continue
        close = "." if frame[0] == "stmt" else "]"
        if done is None:
            if frame[2] is None:
                frame[2] = verb()
            done = node(False)
            if done is None:
                continue
        emit(frame[1], frame[2], done)
        done = None
        k, v = take("mark")
        while v == ";":
            frame[2] = None
            if peek() == ("mark", ";"):
                i += 1
                continue
            if peek() == ("mark", close):
                k, v = take("mark")
            break
        if v == close:
            stack.pop()
            done = frame[1] if frame[0] == "[" else None
        elif v not in (",", ";"):
            fail(f"expected '.', ';' or ',', found {v!r}")
    return out, prefixes


def _term(value: str, kind: int, dt: str | None, lang: str | None) -> str:
    if kind == t.IRI:
        return f"<{value}>"
    if kind == t.BLANK:
        return f"_:{value}"
    text = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{text}"' + (f"@{lang}" if lang else f"^^<{dt}>" if dt and dt != t.XSD + "string" else "")


def serialise(triples: list[tuple], prefixes: dict[str, str] | None = None) -> str:
    """Turtle, one subject to a block, in order."""
    spaces = sorted((prefixes or {}).items(), key=lambda x: -len(x[1]))

    def show(value, kind, dt=None, lang=None):
        if kind == t.IRI:
            for name, space in spaces:
                if value.startswith(space) and re.fullmatch(r"[A-Za-z_][\w-]*", value[len(space) :]):
                    return f"{name}:{value[len(space):]}"
        return _term(value, kind, dt, lang)

    lines = [f"@prefix {name}: <{space}> ." for name, space in sorted((prefixes or {}).items())]
    last = None
    for s, s_kind, p, o, o_kind, dt, lang in sorted(triples, key=lambda x: tuple(str(v) for v in x)):
        predicate = "a" if p == t.TYPE else show(p, t.IRI)
        body = f"{predicate} {show(o, o_kind, dt, lang)}"
        if (s, s_kind) == last:
            lines[-1] = lines[-1][:-2] + " ;"
            lines.append(f"    {body} .")
        else:
            lines += ["", f"{show(s, s_kind)} {body} ."]
        last = (s, s_kind)
    return "\n".join(lines) + "\n"
