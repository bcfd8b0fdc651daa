"""Licences that no single line holds: wrapped notices, notices among other words, full texts."""

import pytest

from brookline.llm import licenses

FULL = dict(licenses.FULL_TEXTS)
GPL = "This work is licensed under the GNU\n * General Public License,\n * version 3."
PROSE = "\n".join(f"some words of row {i} about nothing in particular" for i in range(40))
CASES = {
    "reserved": ("Copyright 2024 Acme Corporation. All rights reserved.", 1, "Proprietary", 1.0),
    "comment": ("// This file is part of foo. Licensed under the Apache License, Version 2.0.", 1, "Apache-2.0", 1.0),
    "wrapped": (f"{PROSE}\n{GPL}\n{PROSE}", 1, "GPL-3.0", 1.0),
    "twice": (f"{GPL}\n{PROSE}\n{GPL}\n{PROSE}", 2, "GPL-3.0", 1.0),
    "line_too": (f"{PROSE}\nLicensed under the MIT License.\n{PROSE}\n{GPL}", 2, "GPL-3.0,MIT", 1.0),
    "mit": (f"MIT License\n\nCopyright (c) 2024 Foo\n\n{FULL['MIT']}", 1, "MIT", 1.0),
    "mit_inside": (f"{PROSE}\n{FULL['MIT']}\n{PROSE}", 1, "MIT", 1.0),
    "edited": (f"{PROSE}\n{FULL['MIT'].replace('substantial', 'large').replace('sell', 'rent or sell')}\n{PROSE}", 1, "MIT", 0.9),
    "none": (f"{PROSE}\nsoftware is released by people under conditions\n{PROSE}", 0, "", None),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t[0]) for i, t in enumerate([*CASES.values(), *((f"{PROSE}\n{x}\n{PROSE}",) for x in FULL.values())])]
    return [r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]


@pytest.mark.parametrize("case", CASES)
def test_windows(found, case):
    r, (_, n, names, least) = found[list(CASES).index(case)], CASES[case]
    assert (r.n_units, r.licenses) == (n, names)
    assert r.best_dice is None if least is None else r.best_dice >= least


@pytest.mark.parametrize("name", FULL)
def test_full_texts(found, name):
    r = found[len(CASES) + list(FULL).index(name)]
    assert r.n_units >= 1 and name in r.licenses.split(",") and r.best_dice == 1.0
