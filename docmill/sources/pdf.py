"""Text of PDF files: what their content streams show, with page, place and font size.

The reader knows objects, object streams and flate streams, text and graphics matrices, and character maps of
fonts. It does not decrypt, and knows no predictors or fonts' built-in encodings; bytes without a map count as Latin-1.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
TOKEN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]/%]*|[-+]?\d*\.?\d+|[A-Za-z'\"*][A-Za-z0-9*]*|%[^\r\n]*", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(a: tuple, b: tuple) -> tuple:
    """The product of two matrices, a first."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def stream_of(body: bytes) -> bytes | None:
    """The decoded stream of an object; None if it has none, or one in another filter."""
    found = re.search(rb"stream\r?\n", body)
    if not found or b"/Crypt" in body[: found.start()]:
        return None
    raw = body[found.end() : body.rfind(b"endstream")]
    filters = re.findall(rb"/(\w+Decode)\b", body[: found.start()])
    if not filters:
        return raw
    return zlib.decompressobj().decompress(raw) if filters == [b"FlateDecode"] else None


def objects_of(content: bytes) -> dict[int, bytes]:
    """Bodies of all objects, those within object streams too; of repeated numbers the last counts."""
    found = {int(m[1]): m[2] for m in OBJECT.finditer(content)}
    for body in list(found.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body):
            data, first = stream_of(body), re.search(rb"/First\s+(\d+)", body)
            if data and first:
                head = [int(x) for x in data[: int(first[1])].split()]
                starts = [int(first[1]) + x for x in head[1::2]]
                for number, lo, hi in zip(head[::2], starts, [*starts[1:], len(data)], strict=True):
                    found.setdefault(number, data[lo:hi])
    return found


def reference(body: bytes, name: bytes) -> list[int]:
    """Objects that an entry of a dictionary names, one or a list."""
    found = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", found[1])] if found else []


def pages_of(objects: dict[int, bytes]) -> list[int]:
    """Pages in their order; without a tree, in the order of their numbers."""
    roots = [k for k, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b]
    out, todo, seen = [], roots[:1], set()
    while todo:
        k = todo.pop(0)
        if k in seen or k not in objects:
            continue
        seen.add(k)
        if re.search(rb"/Type\s*/Pages\b", objects[k]):
            todo = reference(objects[k], rb"Kids") + todo
        else:
            out.append(k)
    return out or sorted(k for k, b in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", b))


def text_map(data: bytes) -> dict[int, str]:
    """Codes and characters of a font's ToUnicode map."""
    out, char = {}, lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        out |= {int(a, 16): char(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out |= {int(a, 16) + k: chr(ord(char(c)[0]) + k) for k in range(min(int(b, 16) - int(a, 16) + 1, 65536))}
    return out


def fonts_of(page: bytes, objects: dict[int, bytes]) -> dict[bytes, dict[int, str]]:
    """Maps of the page's fonts that have one."""
    whole = page + b"".join(objects.get(k, b"") for k in reference(page, rb"Resources"))
    found = re.search(rb"/Font\s*<<(.*?)>>", whole, re.S)
    names = re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", found[1] if found else b"".join(objects.get(k, b"") for k in reference(whole, rb"Font")))
    out = {}
    for name, number in names:
        for k in reference(objects.get(int(number), b""), rb"ToUnicode"):
            data = stream_of(objects.get(k, b""))
            if data:
                out[b"/" + name] = text_map(data)
    return out


def plain(token: bytes, font: dict[int, str] | None) -> str:
    """The text of a string in parentheses or in hexadecimal digits."""
    if token[:1] == b"(":
        raw = re.sub(rb"\\(\d{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r", b"\r\n") else m[1]), token[1:-1], flags=re.S)
    else:
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if font:
        wide = 2 if max(font, default=0) > 255 or token[:1] == b"<" and len(raw) % 2 == 0 else 1
        return "".join(font.get(int.from_bytes(raw[k : k + wide]), "") for k in range(0, len(raw), wide))
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def shown(data: bytes, fonts: dict[bytes, dict[int, str]]) -> list[tuple[float, float, float, str]]:
    """(y, x, size, text) of each piece of text that a content stream shows."""
    out, stack, kept, array = [], [], [], None
    ctm, line, at, size, lead, font = ONE, ONE, ONE, 0.0, 0.0, None

    def move(x: float, y: float) -> None:
        nonlocal line, at
        line = at = times((1.0, 0.0, 0.0, 1.0, x, y), line)

    def show(text: str) -> None:
        nonlocal at
        whole = times(at, ctm)
        scale = (whole[2] ** 2 + whole[3] ** 2) ** 0.5
        if text:
            out.append((whole[5], whole[4], round(size * scale, 2), text))
        at = times((1.0, 0.0, 0.0, 1.0, size * 0.5 * len(text), 0.0), at)  # widths of glyphs are not read

    for m in TOKEN.finditer(data):
        t = m[0]
        if t[:1] in b"(<" and t != b"<<":
            (array if array is not None else stack).append(t)
        elif t == b"[":
            array = []
        elif t == b"]":
            stack.append(array or [])
            array = None
        elif t[:1] in b"+-.0123456789":
            (array if array is not None else stack).append(float(t))
        elif t[:1] == b"/":
            stack.append(t)
        elif t[:1] != b"%" and array is None:
            n = [x for x in stack if isinstance(x, float)]
            if t == b"BT":
                line = at = ONE
            elif t == b"q":
                kept.append(ctm)
            elif t == b"Q" and kept:
                ctm = kept.pop()
            elif t == b"cm" and len(n) >= 6:
                ctm = times(tuple(n[-6:]), ctm)
            elif t == b"Tf" and n:
                size, font = n[-1], fonts.get(next((x for x in stack if isinstance(x, bytes)), b""))
            elif t == b"TL" and n:
                lead = n[-1]
            elif t in (b"Td", b"TD") and len(n) >= 2:
                lead = -n[-1] if t == b"TD" else lead
                move(n[-2], n[-1])
            elif t == b"Tm" and len(n) >= 6:
                line = at = tuple(n[-6:])
            elif t == b"T*":
                move(0.0, -lead)
            elif t in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                if t != b"Tj":
                    move(0.0, -lead)
                show(plain(stack[-1], font))
            elif t == b"TJ" and stack and isinstance(stack[-1], list):
                # a wide step back stands for a space
                show("".join(plain(x, font) if isinstance(x, bytes) else " " if x < -200 else "" for x in stack[-1]))
            stack = []
    return out


def read_pdf(content: bytes) -> list[tuple[int, int, float, float, str, bool]]:
    """(page, block, y, font size, text, image) of each block, in reading order; a page without text has one empty block.

    Pieces of one line are joined by place; lines of one font size no further apart than twice it make a block.
    """
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    objects, out = objects_of(content), []
    for number, key in enumerate(pages_of(objects), 1):
        page = objects[key]
        data = b"\n".join(filter(None, (stream_of(objects.get(k, b"")) for k in reference(page, rb"Contents"))))
        whole = page + b"".join(objects.get(k, b"") for k in reference(page, rb"Resources"))
        named = [int(k) for x in re.findall(rb"/XObject\s*<<(.*?)>>", whole, re.S) for k in re.findall(rb"(\d+)\s+\d+\s+R", x)]
        image = b"\nBI" in b"\n" + data or any(re.search(rb"/Subtype\s*/Image\b", objects.get(k, b"")) for k in named)
        lines: list[list] = []  # [y, size, text]
        for y, x, size, text in sorted(shown(data, fonts_of(page, objects)), key=lambda p: (-round(p[0], 1), p[1])):
            if lines and abs(lines[-1][0] - y) < 0.5:
                lines[-1][2] += ("   " if x - lines[-1][3] > 3 * size else " " if x - lines[-1][3] > 0.2 * size else "") + text
                lines[-1][1], lines[-1][3] = max(lines[-1][1], size), x + 0.5 * size * len(text)
            else:
                lines.append([y, size, text, x + 0.5 * size * len(text)])
        blocks: list[list] = []
        for y, size, text, _ in lines:
            if blocks and abs(blocks[-1][1] - size) < 0.5 and blocks[-1][3] - y <= 2 * size:
                blocks[-1][2] += "\n" + text
                blocks[-1][3] = y
            else:
                blocks.append([y, size, text, y])
        out += [(number, k, y, size, text.strip("\n"), image) for k, (y, size, text, _) in enumerate(blocks)] or [(number, 0, 0.0, 0.0, "", image)]
    return out
