"""Documents that are a whole licence, through the registered query."""

import json
import textwrap

from kinlake.llm import licenses

IDS = {"0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense"}


def test_whole_licenses_are_found(spark, tmp_path):
    rows, want = [], {}

    def add(text, license_id):
        want[len(rows)] = license_id
        rows.append((len(rows), text))

    for x in json.loads(licenses.BUNDLED.read_text(encoding="utf-8")):
        add(x["text"], x["license_id"])
        for title in x["titles"]:
            add(f"{title}\n\nCopyright (c) 2020 Someone\n\n{x['text']}", x["license_id"])
        add("One more line.\n" + x["text"], None)
    mit = dict(licenses.KNOWN)["MIT"]
    add("MIT License\n\nCopyright (c) 2020 Someone\n\n" + textwrap.fill(mit, 78), "MIT")
    add("Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + next(x["text"] for x in json.loads(licenses.BUNDLED.read_text(encoding="utf-8")) if x["license_id"] == "BSD-2-Clause"), "BSD-2-Clause")
    assert set(want.values()) == IDS | {None}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["license_id"] for r in licenses.op7_license_scan(spark, str(tmp_path)).collect()}
    assert got == want
