import hashlib
import zlib

import pytest

from quire.sources import pdf_source
from quire.sources.pdf import crypto
from quire.sources.pdf.document import Document
from quire.sources.pdf.extract import PasswordError, extract
from quire.sources.pdf.fonts import CMap
from quire.sources.pdf.lexer import END, Lexer, Name, Ref
from quire.sources.pdf.writer import text_page, write_pdf


def shown(data, password=None):
    return "".join(g[2] for g in extract(data, password)[1])


def page(body, **options):
    return write_pdf([body], **options)


def test_lexer():
    lexer = Lexer(b"% note\n[1 -2.5 (a\\(b\\051\\n\\\n(c)) <4 1 4> /N#20 true null 3 0 R +x] << /A 1 /B [/C] >>")
    assert lexer.value() == [1, -2.5, b"a(b)\n(c)", b"A@", Name("N#20"), True, None, Ref((3, 0)), 0]
    assert lexer.value() == {"A": 1, "B": ["C"]} and lexer.value() is END


def test_text_and_boxes():
    pages, glyphs = extract(page(text_page([(100, 700, "Hi")])))
    assert pages == [(0, 0.0, 0.0, 612.0, 792.0, 0)]
    assert [g[2] for g in glyphs] == ["H", "i"]
    assert glyphs[1][3:7] == pytest.approx((106, 698.43, 112, 706.29))


def test_operators():
    assert shown(page(b"BT /F1 10 Tf 14 TL 10 100 Td (a) Tj (b) ' 1 2 (c) \" [(d) -500 (e)] TJ T* (f) Tj ET")) == "abcdef"
    _, g = extract(page(b"BT /F1 10 Tf 5 Ts 200 Tz 1 Tc 2 0 0 2 10 20 Tm (ab) Tj ET"))
    assert g[1][3] - g[0][3] == pytest.approx((6 + 1) * 2 * 2) and g[0][4] == pytest.approx(20 + 2 * (5 - 1.57))
    _, g = extract(page(b"q 1 0 0 1 50 0 cm BT /F1 10 Tf (a) Tj ET Q BT /F1 10 Tf (b) Tj ET"))
    assert g[0][3] == 50 and g[1][3] == 0


def test_text_matrix_is_graphics_state():
    _, g = extract(page(b"BT /F1 10 Tf 1 0 0 1 70 80 Tm q 1 0 0 1 240 250 Tm (A) Tj Q (B) Tj ET"))
    assert [(x[2], x[3]) for x in g] == [("A", 240), ("B", 70)]


def test_crypt_filter_must_be_there():
    s = crypto.Security.__new__(crypto.Security)
    s.v = 4
    assert s._filter({"CF": {"S": {"CFM": Name("V2")}}, "StmF": Name("S")}, "StmF") == "V2"
    assert s._filter({"StmF": Name("Identity")}, "StmF") == "None" and s._filter({"CF": {"S": {}}, "StmF": Name("S")}, "StmF") == "None"
    for d in ({"StmF": Name("S")}, {"CF": {}, "StmF": Name("S")}, {"CF": {"S": 1}, "StmF": Name("S")}):
        with pytest.raises(crypto.MalformedEncryption):
            s._filter(d, "StmF")


def test_visibility():
    white = b"1 1 1 rg BT /F1 10 Tf 10 10 Td (w) Tj ET "
    assert shown(page(white)) == "w"  # no fill was painted
    assert shown(page(b"0.9 g 300 300 5 5 re f " + white)) == ""
    assert shown(page(b"0 0 1 rg 0 0 50 50 re f " + white)) == "w"
    assert shown(page(b"BT /F1 10 Tf 3 Tr (x) Tj ET")) == ""
    assert shown(page(b"/P << /MCID 0 >> BDC BT /F1 10 Tf 3 Tr (x) Tj ET EMC")) == "x"
    assert shown(page(b"/Artifact BMC /P << /MCID 0 >> BDC BT /F1 10 Tf 3 Tr (x) Tj ET EMC EMC")) == ""


def test_clip():
    body = b"q 0 0 9 50 re W n BT /F1 10 Tf 0 10 Td (abc) Tj ET Q"
    _, g = extract(page(body))
    assert [x[2] for x in g] == ["a", "b"] and g[1][5] == 9  # half of b is left
    assert shown(page(body.replace(b"9 50", b"7 50"))) == "a"  # a sixth of b is not enough


def test_inline_image_is_skipped():
    assert shown(page(b"BT /F1 10 Tf (a) Tj ET BI /W 2 /H 2 ID (x) Tj EIEI \x00\x01 EI BT /F1 10 Tf (b) Tj ET")) == "ab"


def test_form_and_annotation():
    form = b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0] /Resources << /Font << /F1 3 0 R >> >> /Length 26 >>\nstream\nBT /F1 10 Tf (form) Tj ET  \nendstream"
    data = write_pdf([b"/X Do"], objects={1000: form})
    data = data.replace(b"/Resources << /Font << /F1 3 0 R >> >> /Contents", b"/Resources << /Font << /F1 3 0 R >> /XObject << /X 1000 0 R >> >> /Contents", 1)
    pages, g = extract(data)
    assert "".join(x[2] for x in g) == "form" and g[0][3] == 100
    note = b"<< /Subtype /Form /BBox [0 0 10 10] /Resources << /Font << /F1 3 0 R >> >> /Length 24 >>\nstream\nBT /F1 10 Tf (note) Tj ET\nendstream"
    data = write_pdf([b""], page_extra="/Annots [<< /Rect [200 300 220 310] /AP << /N << /On 1000 0 R >> >> >>]", objects={1000: note})
    _, g = extract(data)
    assert "".join(x[2] for x in g) == "note" and g[0][3] == 200 and g[1][3] == pytest.approx(212)  # twice as wide


def test_damage():
    data = page(text_page([(10, 10, "ok")]))
    assert shown(data[: data.index(b"trailer")]) == ""
    assert extract(b"garbage") == ([], []) and extract(b"") == ([], [])
    length = data.index(b"/Length ") + 8
    assert shown(data[:length] + b"9" + data[length:]) == "ok"  # a wrong length
    body = zlib.compress(text_page([(10, 10, "x" * 50)]))
    cut = write_pdf([b"", b""]).replace(zlib.compress(b""), body[:-8], 1)
    assert len(extract(cut)[0]) == 2


def test_object_stream_fills_gaps():
    inner = b"3 0 << /Type /Font /Subtype /Type1 /BaseFont /Courier >>"
    packed = zlib.compress(inner)
    data = write_pdf([text_page([(0, 0, "a")])])
    start = data.index(b"3 0 obj")
    data = data[:start] + data[data.index(b"endobj", start) + 7 :]
    objstm = b"900 0 obj\n<< /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream\nendobj\n"
    assert shown(data) == "" and shown(data.replace(b"trailer", objstm + b"trailer")) == "a"


def test_cmap_and_composite_font():
    cmap = CMap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <0079>] endbfrange")
    assert cmap.text[2, 1] == "fi" and cmap.text[2, 0x12] == "C" and cmap.text[2, 0x21] == "y"
    assert list(cmap.codes(b"\0\1\0\2")) == [(2, 1), (2, 2)]
    stream = b"<< /Length 95 >>\nstream\n1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00660069> endbfchar\nendstream"
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [1002 0 R] /ToUnicode 1001 0 R >>"
    below = b"<< /Subtype /CIDFontType2 /DW 500 /W [1 [800.4]] >>"
    data = write_pdf([b"BT /F2 10 Tf <00010002> Tj ET"], objects={1000: font, 1001: stream, 1002: below}).replace(b"/F1 3 0 R >> >>", b"/F2 1000 0 R >> >>", 1)
    _, g = extract(data)
    assert "".join(x[2] for x in g[:2]) == "fi" and g[0][5] - g[0][3] == pytest.approx(4) and g[1][5] == pytest.approx(8)


def encrypted(password: bytes, aes: bool):
    """A file encrypted as a writer would, revision 3 or 4."""
    fid, o, p = b"0123456789abcdef", bytes(range(32)), -4
    base = {"Filter": Name("Standard"), "V": 4 if aes else 2, "R": 4 if aes else 3, "Length": 128, "O": o, "U": b"\0" * 32, "P": p}
    if aes:
        base |= {"CF": {"S": {"CFM": Name("AESV2")}}, "StmF": Name("S"), "StrF": Name("S")}
    s = crypto.Security.__new__(crypto.Security)
    s.v, s.r, s.o, s.id, s.p, s.size, s.metadata = base["V"], base["R"], o, fid, (p & 0xFFFFFFFF).to_bytes(4, "little"), 16, True
    key = s._key(password)
    x = hashlib.md5(crypto.PAD + fid).digest()
    for i in range(20):
        x = crypto.rc4(bytes(k ^ i for k in key), x)
    body = text_page([(10, 10, "secret")])
    own = hashlib.md5(key + (11).to_bytes(3, "little") + b"\0\0" + (b"sAlT" if aes else b"")).digest()
    if aes:
        body = aes_encrypt(own, body)
    else:
        body = crypto.rc4(own, body)
    data = write_pdf([b"@"], compress=False).replace(b"/Length 1 >>\nstream\n@", b"/Length %d >>\nstream\n" % len(body) + body)
    extra = b"/CF << /S << /CFM /AESV2 >> >> /StmF /S /StrF /S" if aes else b""
    enc = b"800 0 obj\n<< /Filter /Standard /V %d /R %d /Length 128 /O <%s> /U <%s> /P -4 %s >>\nendobj\n" % (base["V"], base["R"], o.hex().encode(), (x + b"\0" * 16).hex().encode(), extra)
    return data.replace(b"trailer\n<< ", enc + b"trailer\n<< /Encrypt 800 0 R /ID [<%s>] " % fid.hex().encode())


def aes_encrypt(key: bytes, data: bytes) -> bytes:
    """CBC through a table of the inverse of block decryption: bytes are found by running the cipher forwards."""
    box, _, _ = crypto._tables()
    keys, t = crypto._round_keys(key), crypto._times

    def block(b):
        s = bytes(x ^ y for x, y in zip(b, keys[0]))
        for r in range(1, 11):
            s = bytes(box[s[(i + 4 * (i % 4)) % 16]] for i in range(16))
            if r < 10:
                s = bytes(t(s[c], 2) ^ t(s[c // 4 * 4 + (c + 1) % 4], 3) ^ s[c // 4 * 4 + (c + 2) % 4] ^ s[c // 4 * 4 + (c + 3) % 4] for c in range(16))
            s = bytes(x ^ y for x, y in zip(s, keys[r]))
        return s

    pad = 16 - len(data) % 16
    data, last, out = data + bytes([pad]) * pad, bytes(16), [bytes(16)]
    for i in range(0, len(data), 16):
        last = block(bytes(x ^ y for x, y in zip(data[i : i + 16], last)))
        out.append(last)
    return b"".join(out)


@pytest.mark.parametrize("aes", [False, True])
def test_encryption(aes):
    assert shown(encrypted(b"", aes)) == "secret"
    assert shown(encrypted(b"pw", aes), b"pw") == "secret"
    with pytest.raises(PasswordError):
        extract(encrypted(b"pw", aes), b"other")


def test_known_cipher_values():
    keys = crypto._round_keys(bytes(range(16)))
    assert crypto.aes_block(keys, bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")).hex() == "00112233445566778899aabbccddeeff"
    assert crypto.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"


def test_unsupported_filter_gives_no_text():
    assert Document(b"1 0 obj << /Filter /LZWDecode /Length 1 >>\nstream\nx\nendstream endobj").decode(Ref((1, 0))) is None


def test_tables(spark, tmp_path):
    one = write_pdf([text_page([(100, 700, "Hello"), (100, 700, "Hello"), (200, 700, "World")]), text_page([(10, 20, "Two")])])
    turned = write_pdf([text_page([(100, 700, "Up"), (-900, 0, "off")])], page_extra="/Rotate 90")
    df = spark.createDataFrame([("a", bytearray(one), None), ("b", bytearray(turned), None), ("c", bytearray(encrypted(b"pw", False)), b"pw"), ("d", bytearray(encrypted(b"pw", False)), b"no"), ("e", bytearray(b"junk"), None), ("f", None, None)], "doc_id string, content binary, password binary")
    parsed = pdf_source.parse_pdfs(df)
    blocks = {(r.doc_id, r.text): r for r in pdf_source.blocks_of(parsed).collect()}
    assert set(blocks) == {("a", "Hello"), ("a", "World"), ("a", "Two"), ("b", "Up"), ("c", "secret")}
    assert tuple(blocks["a", "Hello"].bbox) == pytest.approx((85.71, 100, 93.57, 130))
    assert blocks["a", "Two"].bbox.top == pytest.approx(792 + 792 - 26.29)
    assert tuple(blocks["b", "Up"].bbox) == pytest.approx((100, 698.43, 112, 706.29))
    assert [(r.doc_id, r.kind) for r in pdf_source.errors_of(parsed).collect()] == [("d", "PasswordError")]
    assert pdf_source.chars_of(parsed, style=True).where("doc_id = 'a' AND page_index = 0").count() == 10
    assert {r.doc_id for r in pdf_source.pages_of(parsed).collect()} == {"a", "b", "c"}


def test_stream_and_files(spark, tmp_path):
    from quire.plans.layout_index import LayoutIndex
    from quire.streaming.extract import stream_blocks

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "x.pdf").write_bytes(write_pdf([text_page([(10, 10, "Label"), (60, 10, "42")])]))
    query = stream_blocks(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    query.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["42", "Label"]
    index = LayoutIndex.open(spark, str(folder / "*.pdf"), concurrency=" ON ")
    assert index.text.first().text == "Label 42\n"
    with pytest.raises(ValueError):
        LayoutIndex.open(spark, str(folder), concurrency="many")
