"""Spans, masking, claims, clean-up and replies, by hand-made cases and properties."""

from hypothesis import given, settings, strategies as st

from textloom.functions import spans
from textloom.operators import replies
from textloom.sources import pages

MIXED = "Write to a.b@example.com or see https://example.com/x?y=1. Take 500 mg at Rs. 1,200 (30%) in 12 days; call 9876543210."


def unmask(masked, raws):
    for i, raw in enumerate(raws):
        masked = masked.replace(f"⪉{i}⪊", raw)
    return masked


def test_each_kind_is_claimed_once():
    found = {k: raw for k, raw, *_ in spans.find_spans(MIXED)}
    assert found == {"email": "a.b@example.com", "url": "https://example.com/x?y=1.", "dosage": "500 mg", "price": "Rs. 1,200", "percent": "30%", "number": "12", "phone": "9876543210"}
    masked, raws, _ = spans.mask_text(MIXED)
    assert unmask(masked, raws) == MIXED and "500" not in masked


def test_a_span_that_touches_an_earlier_kind_is_dropped():
    assert [(k, r) for k, r, *_ in spans.find_spans("129876543210")] == [("phone", "9876543210")]


def test_canonical_forms():
    assert spans.canonical("dosage", "500 mg") == spans.canonical("dosage", "500mg")
    assert spans.canonical("dosage", "500 mg") != spans.canonical("dosage", "0.5 g")
    assert spans.canonical("price", "Rs. 1,200") == spans.canonical("price", "INR 1200") == "₹1200"
    assert spans.canonical("url", "https://x.org/a.") == "https://x.org/a"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 ,.%₹@:/Rs.mg5\n٣é", max_size=60))
def test_unmask_undoes_mask(text):
    masked, raws, _ = spans.mask_text(text)
    assert unmask(masked, raws) == text


def test_claims():
    before = "It may reduce pain. It might well prevent harm."
    assert spans.bare_claims(before, "It will reduce pain. It might prevent harm.", "en") == ["reduce"]
    assert spans.bare_claims(before, before, "en") == []
    assert spans.bare_claims(None, None, None) == []


def test_cleanup_of_english():
    assert spans.clean_english_text("Moreover, we act in order to win. furthermore, it helps.") == ("We act to win. It helps.", 2, 1)
    # phrases are tried in list order, so a second opener behind another stays for the next run
    first = spans.clean_english_text("Furthermore, moreover, x")[0]
    assert first == "Moreover, x" and spans.clean_english_text(first)[0] == "X"


def test_replies():
    assert replies.read_reply_text('```json\n{"text": "one\n\ntwo", "changes": [1, 2]}\n```')[:3] == (True, "one\n\ntwo", 2)
    assert replies.read_reply_text('{"text": "cut \\"off')[:4] == (True, 'cut "off', 0, True)
    assert replies.read_reply_text('{"other": 1}')[0] is False
    assert replies.read_reply_text("  ")[5] == "empty" and replies.read_reply_text(None)[0] is False
    assert replies.read_reply_text("plain prose")[4] is True


def test_chunks_keep_the_limit():
    text = " ".join(["A sentence of some words."] * 60)
    parts = replies.chunk_text(text)
    assert " ".join(parts) == text and all(len(p.encode()) <= 450 for p in parts) and replies.chunk_text(None) == []


def test_addresses():
    ok = {"example.com/a": "https://example.com/a", " http://Example.org ": "http://example.org/", "localhost": "https://localhost/"}
    assert {k: pages.check_address(k)[1] for k in ok} == ok
    assert [pages.check_address(x)[2] for x in ("", None, "ftp://x.com", "not a url at all", "plain")] == ["empty", "empty", "scheme", "host", "host"]


def test_article():
    body = "".join(f"<p>Paragraph {i} with <b>bold</b> words and enough of them to count as text of an article.</p>" for i in range(5))
    html = f'<html lang="en-GB"><head><title>T</title><meta name="description" content=" d "></head><body><nav>menu</nav><article><h2>H</h2>{body}<ul><li>one<li>two</ul><div class="ad">buy</div></article></body></html>'
    title, about, content, lang = pages.parse_html(html)
    assert (title, about, lang) == ("T", "d", "en-GB")
    assert content.startswith("## H\n") and "- one\n- two" in content and "buy" not in content and "menu" not in content
    assert pages.parse_html(None) == ("", "", "", "")
