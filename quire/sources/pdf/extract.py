"""One document's bytes to its pages and painted characters."""

from __future__ import annotations

from .content import Interpreter
from .crypto import MalformedEncryption, PasswordError, UnsupportedEncryption
from .document import Document


def extract(data: bytes, password: bytes | None = None) -> tuple[list[tuple], list[tuple]]:
    """(pages, glyphs): (page_index, x_min, y_min, width, height, rotation) and (page_index, seq, character, left, low, right, high, size, rgb, font name), in page space."""
    doc = Document(data, password)
    pages, glyphs = [], []
    for index, page in enumerate(doc.pages()):
        crop = doc.box(page.get("CropBox"))
        box = crop or doc.box(page.get("MediaBox")) or (0.0, 0.0, 0.0, 0.0)
        turn = doc.deep(page.get("Rotate"))
        pages.append((index, box[0], box[1], box[2] - box[0], box[3] - box[1], round(turn) if isinstance(turn, (int, float)) else 0))

        def emit(ch, b, st, index=index):
            glyphs.append((index, len(glyphs), ch, b[0], b[1], b[2], b[3], st.size, st.rgb, st.font.name))

        run = Interpreter(doc, emit)
        resources = page.get("Resources")
        run.run(doc.contents(page), resources, clip=crop)
        for stream, matrix in doc.appearances(page):
            body = doc.decode(stream)
            if body is not None:
                run.run(body, stream.dict.get("Resources", resources), matrix, crop)
    return pages, glyphs


__all__ = ["MalformedEncryption", "PasswordError", "UnsupportedEncryption", "extract"]
