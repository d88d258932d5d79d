"""Known licences are found wherever their lines are wrapped."""

import textwrap

from corpusmill.llm import licences


def test_rewrapped_licences(spark):
    rows, want = [], {}
    for name, text in licences.WHOLE:
        head, _, body = text.partition("\n")
        words = " ".join(body.split())
        for width in (40, 66, 78, 90, 10**6):
            for top in ("", "Copyright (c) 2020-2023 Some Body, Inc. All rights reserved.\n", "Copyright Somebody Else\n\n"):
                wrapped = "\n".join(textwrap.wrap(top + words, width, break_on_hyphens=False))
                for t in (f"{head}\n{top}\n{wrapped[len(top):] if not top else words}", f"{head}\n{wrapped}"):
                    want[len(rows)] = name
                    rows.append((len(rows), t))
    got = {r["doc_id"]: r["license_id"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_misses_and_lines(spark):
    bodies = dict(reversed(licences.WHOLE))
    isc = " ".join(dict(licences.KNOWN)["ISC"].split())
    rows = [(0, bodies["MIT"] + " Not for evil."), (1, "Copyright (c) 2020 A. This must not be sold. " + " ".join(bodies["MIT"].split())), (2, bodies["MIT"].replace("COPYRIGHT HOLDERS", "")), (3, f"some code\n{isc}\nmore code"), (4, "x\nCopyright 2020 A B. Licensed under the MIT License.\ny")]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k][0] for k in range(5)] == [None] * 5
    assert got[3][1] == "ISC" and got[4][1] == "MIT"


def test_equal_words_in_a_row(spark):
    rows = spark.createDataFrame([(0, "licence licence licence of a licence"), (1, "license license license of a license"), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["digest"] for r in licences.scan(rows).collect()}
    assert got[0] == got[1] != got[None] and licences.scan(rows.limit(0)).count() == 0
