"""op5 against its SQL and on planted texts."""

import os

import pytest

from tests.oracle import connect, differences
from viewspan.llm import licenses as L

SF = "/root/testdata/sf0.001"


def test_against_sql(spark):
    assert differences(L.op5_license_scan(spark, SF), connect(SF), L.OP5_SQL) is None


def test_planted(spark):
    mit = next(t for n, t in L.KNOWN if n == "MIT" and t.startswith("MIT License"))
    rows = [
        (1, None), (2, ""), (3, "?!\n..."), (4, mit), (4, mit), (5, mit.upper().replace("License", "Licence") + "\n\n"), (6, mit.replace("MIT License\n", "MIT License\n\nCopyright (c) 2020 Someone\nAll rights reserved.")),
        (7, mit + " extra"), (None, "a\nReleased under the MIT licence!\nLicensed under CC BY-NC 4.0\nreleased, under the mit license"), (9, "x " * 100_000),
    ]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, digest int, license int")
    got = {}
    for r in L.license_scan(df).collect():
        got.setdefault(r["doc_id"], []).append((r["text_license"], r["n_license_lines"], r["line_licenses"]))
    none = [(None, 0, "")]
    assert got == {1: none, 2: none, 3: none, 4: [("MIT", 0, "")] * 2, 5: [("MIT", 0, "")], 6: [("MIT", 0, "")], 7: none, None: [(None, 3, "CC-BY-NC-4.0,MIT")], 9: none}
    assert L.license_scan(df.limit(0)).count() == 0


FULL = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(FULL), reason="no full license texts on this machine")
def test_full_texts(spark):
    """Whole long licenses, headed by other holders and broken at other places; a part of one is not a license."""
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for f, n in names.items():
        with open(f"{FULL}/{f}", encoding="utf-8") as x:
            text = x.read()
        rows += [(n, text), (n, "Copyright: 2020 Someone\nCopyright The Example Authors\n\n" + text.replace("   ", " ")), (None, text[: len(text) // 2])]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["text_license"] for r in L.license_scan(df).collect()}
    assert [got[k] for k in range(len(rows))] == [n for n, _ in rows]
