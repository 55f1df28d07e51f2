"""Page counts of PDF files made here: by tables, compressed tables, revisions, and by objects."""

import random

import pytest

from leafmark.plans.file_queries import _pdf
from leafmark.sources import pdf, pdfcount


@pytest.mark.parametrize("kind", range(4))
@pytest.mark.parametrize("junk", [b"", b"junk before\n"])
def test_kinds(kind, junk):
    """Plain, compressed, and revised files by their tables alone; one without by its objects."""
    for n in (0, 1, 7, 1234):
        data = junk + _pdf(n, kind)
        assert pdfcount.count(data) == n
        if kind < 3:
            assert pdfcount.Document(data).count() == n
        else:
            with pytest.raises(pdfcount.Broken):
                pdfcount.Document(data).count()


def test_broken_tables_fall_back_to_objects():
    """Wherever the table points, and with the table cut: the newest tree that the root names."""
    rng = random.Random(1)
    for kind in (0, 1, 2):
        data = _pdf(5, kind)
        at = data.rfind(b"startxref")
        assert pdfcount.count(data[:at]) == (14 if kind == 2 else 5)  # the revision before is whole
        assert pdfcount.count(data[:at] + b"startxref\n%d\n%%%%EOF" % rng.randint(1, len(data) - 1)) == 5
    shifted = _pdf(6, 0).replace(b"1 0 obj\n", b"1 0 obj\n%% longer than the table knows\n")
    assert pdfcount.count(shifted) == 6


def test_page_trees_that_arent_the_roots_dont_count():
    data = _pdf(3, 0)
    other = b"9 0 obj\n<< /Type /Pages /Parent 2 0 R /Count 99 >>\nendobj\n"
    assert pdfcount.count(data + other) == 3
    text = b"8 0 obj\n(/Type /Pages /Count 55 \\) nested (a) end)\nendobj\n"
    assert pdfcount.count(text + data) == 3


def test_values():
    data = b"<</A[1 2.5 -3 4 0 R/N(a(b)\\))<6162>]/B<</C true/D null>>%c\n>> x"
    value, end = pdfcount.parse(data, 0)
    assert value == {"A": [1, 2.5, -3, pdfcount.Ref(4), "/N", b"a(b)\\)", b"6162"], "B": {"C": True, "D": None}} and data[end:] == b" x"
    for bad in (b"<</A", b"[1 2", b"(open", b"<61", b"<<1 2>>", b">>"):
        with pytest.raises(pdfcount.Broken):
            pdfcount.parse(bad, 0)


def test_predictors():
    rng = random.Random(2)
    rows = [bytes(rng.randrange(256) for _ in range(6)) for _ in range(12)]
    raw, above = b"", bytes(6)
    for i, row in enumerate(rows):
        kind, made = i % 5, bytearray()
        for j, x in enumerate(row):
            left, up, corner = row[j - 1] if j else 0, above[j], above[j - 1] if j else 0
            p = left + up - corner
            near = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            made.append((x - (0, left, up, (left + up) // 2, near)[kind]) & 255)
        raw, above = raw + bytes([kind]) + bytes(made), row
    assert pdfcount._unpredicted(raw, {"Predictor": 15, "Columns": 6}) == b"".join(rows)


def test_scan(spark, tmp_path):
    for i in range(8):
        (tmp_path / f"{i}.pdf").write_bytes(_pdf(i, i % 4))
    (tmp_path / "bad.pdf").write_bytes(b"no file of this kind")
    parse = lambda content: ["a", "b"] if b"kind" in content else None
    got = {r["book"].rsplit("/", 1)[-1]: (r["total_pages"], r["status"]) for r in pdf.read_page_counts(spark, str(tmp_path), parse).collect()}
    assert got == {f"{i}.pdf": (i, "ok") for i in range(8)} | {"bad.pdf": (2, "ok")}
