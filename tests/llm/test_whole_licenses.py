from pathlib import Path

import pytest

from keyloom.llm import license_scan

FOLDER = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GPL-1.0": "GPL-1", "LGPL-2.0": "LGPL-2", "MPL-1.1": "MPL-1.1", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "Artistic-1.0": "Artistic"}


@pytest.mark.skipif(not all((FOLDER / f).exists() for f in FILES.values()), reason="needs the system's licence texts")
def test_entire_licenses(spark, scratch):
    rows = [(name, "\n\n" + (FOLDER / f).read_text().upper().replace("\n", "  \n")) for name, f in FILES.items()]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.whole_license for r in license_scan.license_scan(docs, license_scan.known(spark), scratch).collect()}
    assert got == {name: name for name in FILES}
