"""Text of PDF files and plain PDF files of text, with the standard library alone (SRC-02, 07, SNK-06).

Read are uncompressed and Flate streams, object streams, literal and hex strings, simple fonts
(Windows Latin or a ``ToUnicode`` map) and composite ones with such a map. Encrypted files and
other filters raise ``ValueError``.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
_STREAM = re.compile(rb"stream\r?\n")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9*]?", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Bytes that a stream may unpack to.
MOST_BYTES = 256 << 20
PAGE = (595, 842)
LEFT, TOP, SIZE, STEP, LINES = 50, 800, 10, 14, 54


def _unpack(body: bytes) -> tuple[bytes, bytes | None]:
    """Dictionary and decoded stream of an object."""
    found = _STREAM.search(body)
    if not found:
        return body, None
    head, data = body[: found.start()], body[found.end() : body.rfind(b"endstream")]
    if length := re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head):
        data = body[found.end() : found.end() + int(length[1])]
    filters = re.findall(rb"/(\w+Decode)", head)
    for name in filters:
        if name != b"FlateDecode":
            return head, None
        unpack = zlib.decompressobj()
        data = unpack.decompress(data.rstrip(b"\r\n") if not length else data, MOST_BYTES)
        if unpack.unconsumed_tail:
            raise ValueError(f"a stream unpacks to more than {MOST_BYTES} bytes")
    return head, data


def _objects(content: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    out = {}
    for number, body in _OBJECT.findall(content):
        out[int(number)] = _unpack(body)
    for head, data in list(out.values()):
        if b"/ObjStm" in head and data is not None:
            first = int(re.search(rb"/First\s+(\d+)", head)[1])
            numbers = list(map(int, data[:first].split()))
            ends = [*numbers[3::2], len(data) - first]
            for number, at, end in zip(numbers[::2], numbers[1::2], ends):
                out.setdefault(number, (data[first + at : first + end], None))
    return out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m: re.Match) -> bytes:
        x = m[1]
        return _ESCAPES.get(x) or (b"" if x in (b"\n", b"\r\n") else bytes([int(x, 8) & 255]) if x[:1].isdigit() else x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def _unicode_map(data: bytes) -> dict[int, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out |= {code: chr(int(c, 16) + code - int(a, 16)) for code in range(int(a, 16), int(b, 16) + 1)}
    return out


class _Font:
    def __init__(self, objects: dict, head: bytes):
        self.wide = b"/Type0" in head
        found = re.search(rb"/ToUnicode\s+(\d+)", head)
        data = objects.get(int(found[1]), (b"", None))[1] if found else None
        self.known = _unicode_map(data) if data else {}

    def text(self, raw: bytes) -> str:
        if self.wide:
            return "".join(self.known.get(int.from_bytes(raw[i : i + 2], "big"), "") for i in range(0, len(raw), 2))
        return "".join(self.known.get(x) or bytes([x]).decode("cp1252", "replace") for x in raw)


def _pages(objects: dict) -> list[bytes]:
    """Page dictionaries in reading order, with what they inherit behind them."""
    out: list[bytes] = []

    def walk(number: int, inherited: bytes, seen: frozenset) -> None:
        head = objects.get(number, (b"", None))[0]
        kids = re.search(rb"/Kids\s*\[(.*?)\]", head, re.S)
        if number in seen:
            raise ValueError("a page tree refers to itself")
        if kids:
            for kid in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                walk(int(kid), head + inherited, seen | {number})
        elif head:
            out.append(head + inherited)

    for head, _ in objects.values():
        if b"/Catalog" in head and (root := re.search(rb"/Pages\s+(\d+)", head)):
            walk(int(root[1]), b"", frozenset())
    return out


def _resolve(objects: dict, head: bytes, name: bytes) -> bytes:
    """The dictionary under a name, direct or referred to."""
    if found := re.search(name + rb"\s+(\d+)\s+\d+\s+R", head):
        return objects.get(int(found[1]), (b"", None))[0]
    found = re.search(name + rb"\s*<<(.*?)>>", head, re.S)
    return found[1] if found else b""


def text_blocks(content: bytes) -> list[tuple[int, int, float, float, str]]:
    """``page, block_no, y0, y1, text`` of each line of text, ``y`` from the top of the page."""
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    if re.search(rb"/Encrypt\s+\d+", content):
        raise ValueError("encrypted PDF files aren't supported")
    objects, out = _objects(content), []
    pages = _pages(objects)
    if not pages:
        raise ValueError("a PDF file without pages")
    for number, head in enumerate(pages):
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", head)
        height = float(box[4]) if box else float(PAGE[1])
        names = _resolve(objects, _resolve(objects, head, rb"/Resources") or head, rb"/Font") or _resolve(objects, head, rb"/Font")
        fonts = {n: _Font(objects, objects.get(int(i), (b"", None))[0]) for n, i in re.findall(rb"(/[^\s/]+)\s+(\d+)\s+\d+\s+R", names)}
        streams = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", head, re.S)
        data = b"\n".join(objects.get(int(i), (b"", b""))[1] or b"" for i in re.findall(rb"(\d+)\s+\d+\s+R", (streams[1] or streams[2]) if streams else b""))
        lines: list[list] = []
        for y, size, text in _shown(data, fonts):
            if lines and abs(lines[-1][0] - y) < 0.5:
                lines[-1][2] += text
            else:
                lines.append([y, size, text])
        out += [(number, i, round(height - y - size, 3), round(height - y, 3), text) for i, (y, size, text) in enumerate(x for x in lines if x[2].strip())]
    return out


def _shown(data: bytes, fonts: dict[bytes, _Font]):
    """Height, size and text of each string shown."""
    plain = _Font({}, b"")
    stack: list = []
    font, size, y, lead, inside = plain, 1.0, 0.0, 0.0, None
    for token in _TOKEN.findall(data):
        kind = token[:1]
        if kind in b"(<":
            (stack if inside is None else inside).append(token)
        elif token == b"[":
            inside = []
        elif token == b"]":
            stack, inside = [*stack, inside or []], None
        elif kind in b"/+-.0123456789":
            (stack if inside is None else inside).append(token)
        elif inside is None:
            number = lambda i: float(stack[i])  # noqa: B023, E731
            if token == b"BT":
                y = 0.0
            elif token == b"Tf" and len(stack) > 1:
                font, size = fonts.get(stack[-2], plain), number(-1)
            elif token in (b"Td", b"TD") and len(stack) > 1:
                lead = -number(-1) if token == b"TD" else lead
                y += number(-1)
            elif token == b"TL" and stack:
                lead = number(-1)
            elif token == b"Tm" and len(stack) > 5:
                y = number(-1)
            elif token in (b"T*", b"'", b'"'):
                y -= lead
            if token in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                yield y, size, font.text(_string(stack[-1]))
            elif token == b"TJ" and stack and isinstance(stack[-1], list):
                shown = "".join(font.text(_string(x)) if x[:1] in b"(<" else " " if float(x) < -200 else "" for x in stack[-1])
                yield y, size, shown
            stack = []


def text_of(content: bytes) -> str:
    """Lines of all pages, with the paragraphs that gaps between lines tell apart."""
    blocks = text_blocks(content)
    gaps = sorted(b[2] - a[3] for a, b in zip(blocks, blocks[1:]) if a[0] == b[0] and b[2] - a[3] > 0)
    middle = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2 if gaps else 0.0
    out: list[str] = []
    for k, (page, _, y0, _, text) in enumerate(blocks):
        if k and page == blocks[k - 1][0] and y0 - blocks[k - 1][3] <= -(-middle // 1):
            out[-1] += " " + text
        else:
            out.append(text)
    return "\n\n".join(out)


def pdf_of(text: str, packed: bool = True) -> bytes:
    """A PDF file with a line of text for each line; what Windows Latin lacks becomes a question mark."""
    rows = text.split("\n")
    pages = [rows[i : i + LINES] for i in range(0, len(rows), LINES)] or [[]]
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
    for i, page in enumerate(pages):
        shown = [re.sub(rb"([\\()])", rb"\\\1", x.encode("cp1252", "replace").replace(b"\r", b" ")) for x in page]
        data = b"\n".join([b"BT", f"/F1 {SIZE} Tf {STEP} TL {LEFT} {TOP} Td".encode(), *[b"(" + x + b") Tj T*" for x in shown], b"ET"])
        data = zlib.compress(data) if packed else data
        bodies[4 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE[0]} {PAGE[1]}] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode()
        bodies[5 + 2 * i] = f"<< /Length {len(data)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream"
    bodies[2] = f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] >>".encode()
    out, places = bytearray(b"%PDF-1.4\n"), []
    for number in sorted(bodies):
        places.append(len(out))
        out += f"{number} 0 obj\n".encode() + bodies[number] + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{x:010d} 00000 n \n".encode() for x in places)
    return bytes(out + f"trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())
