from __future__ import annotations

from reachway.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
CASES = [
    ("Some text.\nLicensed under CC BY-NC 4.0.", ["cc-by-nc-4.0-reference"], ["CC-BY-NC-4.0"], False),
    ("x\nLicensed under the Apache License, Version 2.0. More!", ["apache-2.0-reference"], ["Apache-2.0"], True),
    (MIT, ["mit-text"], ["MIT"], True),
    (MIT.replace("The above", "All rights reserved. The above"), ["mit-text", "all-rights-reserved"], ["MIT", "LicenseRef-reserved"], False),
    ("\n\n".join(reversed(MIT.split("\n\n"))), [], [], None),
    ("Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.", ["mit-reference", "gpl-3.0-reference"], ["MIT", "GPL-3.0"], True),
    ("the license of this is not licensed under the apache license at all", [], [], None),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n", ["apache-2.0-reference"], ["Apache-2.0"], True),
    (None, [], [], None), ("", [], [], None), ("license " * 20_000, [], [], None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], "x", 1) for i, c in enumerate(CASES)], "doc_id long, text string, Rules string, ids int")
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "text", "ids", "sentence_ids", "rules", "licenses", "reusable"]
    for r in out.collect():
        assert (r.rules, r.licenses, r.reusable) == CASES[r.doc_id][1:], CASES[r.doc_id][0]
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df.union(df)).count() == 2 * len(CASES)
    assert "Python" not in out._jdf.queryExecution().toString()
