from __future__ import annotations

import pytest

from reachway.llm import warc


@pytest.mark.parametrize("compress", [True, False])
def test_a_very_long_url_is_read_back(compress):
    url = "data:," + "x" * 200_000
    one = warc.record(1, url, b"page", None, False)
    found = list(warc.salvage(warc.member(one) if compress else one + b"\r\n\r\n"))
    assert [(p, f["warc-target-uri"], payload) for _, _, p, f, payload in found] == [(None, url, b"page")]
