"""Writes simple PDF files, for tests and for queries that read back what they wrote."""

from __future__ import annotations

import zlib


def _string(text: str) -> bytes:
    raw = text.encode("cp1252", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def text_page(items: list[tuple], font: str = "F1", size: float = 10) -> bytes:
    """A content stream that shows each (x, y, text) or (x, y, text, horizontal scale in percent)."""
    body = [f"BT /{font} {size:g} Tf".encode()]
    now = 100.0
    for x, y, text, *scale in items:
        if scale and scale[0] != now:
            now = scale[0]
            body.append(f"{now:g} Tz".encode())
        body.append(f"1 0 0 1 {x:g} {y:g} Tm ".encode() + _string(text) + b" Tj")
    return b"\n".join([*body, b"ET"])


def write_pdf(pages: list[bytes], base_font: str = "Courier", media: tuple = (0, 0, 612, 792), compress: bool = True, page_extra: str = "", objects: dict[int, bytes] | None = None) -> bytes:
    """A file of content streams with one standard font, F1. page_extra: more page entries; objects: further numbered objects, from 1000 on."""
    out = [b"%PDF-1.5\n"]
    n = len(pages)
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(n))
    out.append(b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n")
    out.append(f"2 0 obj\n<< /Type /Pages /Count {n} /Kids [{kids}] /MediaBox [{' '.join(f'{v:g}' for v in media)}] >>\nendobj\n".encode())
    out.append(f"3 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /{base_font} /Encoding /WinAnsiEncoding >>\nendobj\n".encode())
    for i, body in enumerate(pages):
        data = zlib.compress(body) if compress else body
        how = "/Filter /FlateDecode " if compress else ""
        out.append(f"{10 + 2 * i} 0 obj\n<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {11 + 2 * i} 0 R {page_extra} >>\nendobj\n".encode())
        out.append(f"{11 + 2 * i} 0 obj\n<< {how}/Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n")
    for k, v in (objects or {}).items():
        out.append(f"{k} 0 obj\n".encode() + v + b"\nendobj\n")
    out.append(b"trailer\n<< /Root 1 0 R >>\n%%EOF\n")
    return b"".join(out)
