"""Text of PDF files, by the standard library alone.

Objects are found by scanning the file, not by its cross-reference table, so that files
with a broken one are read too. Streams are plain or deflated, and objects may lie in
object streams. Characters come from a font's ToUnicode map, else they are Windows-1252.
Lines are told apart by moves of the text position. What is not here: other filters,
encrypted files, and the order of columns or tables by their place on the page.
"""

from __future__ import annotations

import re
import zlib

#: A deflated stream may grow to so many bytes.
LARGEST = 64 << 20
OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b")
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
TOKEN = re.compile(rb"""\s*(?:(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))(?![^\s()<>\[\]{}/%])|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<open>\()|(?P<mark>\[|\]|<<|>>)|(?P<word>[^\s()<>\[\]{}/%]+)|(?P<note>%[^\r\n]*)|(?P<other>.))""", re.DOTALL)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Broken(ValueError):
    pass


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose first character after "(" is at ``at``, and the place after its end."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            c = data[at : at + 1]
            if octal := re.match(rb"[0-7]{1,3}", data[at : at + 3]):
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
                continue
            at += 2 if data[at : at + 2] == b"\r\n" else 1
            out += ESCAPES.get(c, b"" if c in (b"\r", b"\n") else c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at
        out += c
    return bytes(out), at


def _tokens(data: bytes):
    """(kind, value) of a content stream: names, numbers, strings, marks and operators."""
    at = 0
    while at < len(data) and (m := TOKEN.match(data, at)):
        at = m.end()
        kind = m.lastgroup
        if kind == "open":
            text, at = _string(data, at)
            yield "string", text
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", m["hex"][1:-1])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "number":
            yield "number", float(m["number"])
        elif kind == "word" and m["word"] == b"BI":  # an image inside the page
            end = re.compile(rb"\sEI(?=\s|$)").search(data, at)
            at = end.end() if end else len(data)
        elif kind in ("name", "mark", "word"):
            yield kind, m[kind]


def _stream(body: bytes) -> bytes | None:
    """The decoded stream of an object; None if it has none."""
    if not (start := re.search(rb"stream\r?\n", body)):
        return None
    head, data = body[: start.start()], body[start.end() : max(start.end(), body.rfind(b"endstream"))]
    filters = re.findall(rb"/(\w+Decode)\b", head)
    if not filters:
        return data
    if filters != [b"FlateDecode"]:
        raise Broken("a filter that is not read here")
    inflate = zlib.decompressobj()
    try:
        out = inflate.decompress(data, LARGEST)
    except zlib.error as e:
        raise Broken("a stream that can't be inflated") from e
    if inflate.unconsumed_tail:
        raise Broken("a stream that is too large")
    return out


def _objects(content: bytes) -> dict[int, bytes]:
    out: dict[int, bytes] = {}
    places = [(int(m[1]), m.end()) for m in OBJECT.finditer(content)]
    for (number, start), (_, following) in zip(places, [*places[1:], (0, len(content))], strict=False):
        end = content.find(b"endobj", start)
        out[number] = content[start : end if end >= 0 else following]  # a later version of an object counts
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body[:2000]):
            data = _stream(body) or b""
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = [int(x) for x in data[:first].split()]
            for number, at, end in zip(heads[::2], heads[1::2], [*heads[3::2], len(data) - first], strict=True):
                out.setdefault(number, data[first + at : first + end])
    return out


def _value(objects: dict[int, bytes], body: bytes, key: bytes) -> bytes:
    """What stands after a key of a dictionary, a reference followed."""
    if not (m := re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*", body)):
        return b""
    rest = body[m.end() :]
    if ref := REFERENCE.match(rest):
        return objects.get(int(ref[1]), b"")
    depth, at = 0, 0
    for part in re.finditer(rb"<<|>>|\[|\]", rest):
        depth += 1 if part[0] in (b"<<", b"[") else -1
        at = part.end()
        if depth <= 0:
            break
    return rest[:at] if rest[:1] in (b"<", b"[") else rest.split(b"/", 2)[0 if rest[:1] != b"/" else 1]


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """Page objects in order of the page tree; by number where there is none."""
    kids = lambda body: [int(n) for n in REFERENCE.findall(_value(objects, body, b"Kids"))]
    is_page = lambda body: re.search(rb"/Type\s*/Page(?!s)\b", body)
    children = {n for body in objects.values() for n in kids(body)}
    roots = [n for n, body in objects.items() if re.search(rb"/Type\s*/Pages\b", body) and n not in children]
    out, seen, waiting = [], set(), roots[::-1]
    while waiting:
        n = waiting.pop()
        if n in seen or n not in objects:
            continue
        seen.add(n)
        if is_page(objects[n]):
            out.append(objects[n])
        waiting += kids(objects[n])[::-1]
    return out or [body for _, body in sorted(objects.items()) if is_page(body)]


def _unicode_map(data: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and the text of each code, of a ToUnicode map."""
    text = lambda digits: bytes.fromhex(digits.decode()).decode("utf-16-be", "ignore")
    width, out = 1, {}
    for part in re.findall(rb"begincodespacerange(.*?)endcodespacerange", data, re.DOTALL):
        width = max([width, *(len(x) // 2 for x in re.findall(rb"<([0-9A-Fa-f]+)>", part))])
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.DOTALL):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[int(a, 16)] = text(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.DOTALL):
        for a, b, to, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", part, re.DOTALL):
            codes = range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1)
            if to:
                start = text(to)
                out |= {c: start[:-1] + chr(ord(start[-1]) + k) for k, c in enumerate(codes) if start}
            else:
                out |= dict(zip(codes, map(text, re.findall(rb"<([0-9A-Fa-f]+)>", listed)), strict=False))
    return width, out


def _fonts(objects: dict[int, bytes], page: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
    resources = _value(objects, page, b"Resources")
    parent = page
    for _ in range(32):  # resources may stand further up the tree
        if resources or not (parent := _value(objects, parent, b"Parent")):
            break
        resources = _value(objects, parent, b"Resources")
    out = {}
    for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R\b", _value(objects, resources, b"Font")):
        if mapped := _value(objects, objects.get(int(number), b""), b"ToUnicode"):
            out[b"/" + name] = _unicode_map(_stream(mapped) or b"")
    return out


def _shown(raw: bytes, font: tuple[int, dict[int, str]] | None) -> str:
    if font is None:
        return raw.decode("cp1252", "replace")
    width, texts = font
    return "".join(texts.get(int.from_bytes(raw[k : k + width], "big"), "") for k in range(0, len(raw), width))


def _page_text(data: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    out: list[str] = []
    held: list[tuple[str, object]] = []
    font, line = None, 0.0

    def broken() -> None:
        if out and out[-1] != "\n":
            out.append("\n")

    for kind, value in _tokens(data):
        if kind != "word":
            held.append((kind, value))
            continue
        numbers = [x for k, x in held if k == "number"]
        if value == b"Tf":
            font = fonts.get(next((x for k, x in held if k == "name"), b""))
        elif value in (b"Td", b"TD") and len(numbers) >= 2 and numbers[-1]:
            broken()
        elif value == b"T*":
            broken()
        elif value == b"Tm" and len(numbers) >= 6:
            if numbers[-1] != line:
                broken()
            line = numbers[-1]
        elif value in (b"Tj", b"'", b'"'):
            if value != b"Tj":
                broken()
            out += [_shown(x, font) for k, x in held if k == "string"]
        elif value == b"TJ":
            for k, x in held:  # a wide gap between two strings is a space
                if k == "string":
                    out.append(_shown(x, font))
                elif k == "number" and x < -200 and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
        held = []
    return "".join(out).strip("\n")


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page, in lines as they are set."""
    if re.search(rb"/Encrypt\s+(?:\d+\s+\d+\s+R|<<)", content):
        raise Broken("encrypted")
    out = []
    try:
        objects = _objects(content)
        for page in _pages(objects):
            m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
            parts = [_stream(objects.get(int(n), b"")) or b"" for n in REFERENCE.findall(m[1])] if m else []
            out.append(_page_text(b"\n".join(parts), _fonts(objects, page)))
    except Broken:
        raise
    except (ValueError, TypeError, KeyError, IndexError) as e:  # any bytes may come
        raise Broken(f"not as a file should be: {e}") from e
    if not out:
        raise Broken("no pages")
    return out
