"""A small writer of PDF pages: headings and tables of text, in one of the fonts that every reader has."""

from __future__ import annotations

from textwrap import wrap

# Fixed values of the page, in points: A4, margin, font size, and what a character is wide, about, for its size.
WIDTH, HEIGHT, MARGIN, SIZE, CHARACTER = 595, 842, 50, 9, 0.56


def _shown(text: str) -> bytes:
    """A string object; characters that Windows-1252 lacks become question marks."""
    raw = text.encode("cp1252", "replace")
    for special in (b"\\", b"(", b")"):
        raw = raw.replace(special, b"\\" + special)
    return b"(" + raw + b")"


class Pages:
    """Draws from top to bottom and begins a new page where one is full."""

    def __init__(self) -> None:
        self.pages: list[list[bytes]] = []
        self.new_page()

    def new_page(self) -> None:
        self.pages.append([])
        self.y = HEIGHT - MARGIN

    def _text(self, x: float, y: float, text: str, size: float) -> None:
        self.pages[-1].append(b"BT /F1 %.1f Tf %.1f %.1f Td %s Tj ET" % (size, x, y, _shown(text)))

    def heading(self, text: str, size: float = 14) -> None:
        for line in wrap(text, int((WIDTH - 2 * MARGIN) / (size * CHARACTER))) or [""]:
            if self.y < MARGIN + 2 * size:
                self.new_page()
            self.y -= 1.6 * size
            self._text(MARGIN, self.y, line, size)
        self.y -= size / 2

    def table(self, rows: list[list[str]]) -> None:
        """Rows of equally wide cells; long texts go over several lines of their cell, and a cell over several pages."""
        for row in rows:
            wide = (WIDTH - 2 * MARGIN) / max(1, len(row))
            cells = [wrap(text, max(1, int((wide - 6) / (SIZE * CHARACTER)))) or [""] for text in row]
            left = max(map(len, cells), default=0)
            while left > 0:
                room = int((self.y - MARGIN) / (SIZE * 1.3))
                if room < min(left, 3):
                    self.new_page()
                    continue
                now = min(left, room)
                high = now * SIZE * 1.3 + 4
                for i, lines in enumerate(cells):
                    x = MARGIN + i * wide
                    self.pages[-1].append(b"%.1f %.1f %.1f %.1f re S" % (x, self.y - high, wide, high))
                    for k, line in enumerate(lines[:now]):
                        self._text(x + 3, self.y - (k + 1) * SIZE * 1.3 + 1, line, SIZE)
                    cells[i] = lines[now:]
                self.y -= high
                left -= now
        self.y -= SIZE

    def document(self) -> bytes:
        """The file: a catalog, the list of pages, the font, and for each page its description and what is drawn."""
        first = 4
        kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(self.pages)))
        objects = [
            b"<< /Type /Catalog /Pages 2 0 R >>",
            b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(self.pages)),
            b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        ]
        for i, drawn in enumerate(self.pages):
            body = b"0.5 w\n" + b"\n".join(drawn)
            objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (WIDTH, HEIGHT, first + 2 * i + 1))
            objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
        out, places = b"%PDF-1.4\n", []
        for number, content in enumerate(objects, 1):
            places.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (number, content)
        table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        return out + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))
