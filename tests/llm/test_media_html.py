import hashlib
import re
import zlib
from html import unescape

import numpy as np
import pytest

from keyloft.llm import jpeg
from keyloft.llm.html import blocks, extract, first_pass, main_text, second_pass
from tests.llm.conftest import EDGES


def payloads():
    rng = np.random.default_rng(0)
    some = [b"", b"a", bytes(range(256)) * 9, rng.integers(0, 256, 100_000, dtype=np.uint8).tobytes(), b"\xff" * 5000, "é日本".encode() * 999, b"x" * 575, b"x" * 576, b"x" * 577]
    return [jpeg.padded(p) for p in some] + [jpeg.padded(None)]


def test_round_trip():
    p = payloads()
    for image, payload in zip(jpeg.decode(jpeg.encode(p)), p):
        assert jpeg.payload_of(image) == payload
    assert jpeg.encode(p) == [jpeg.encode([x])[0] for x in p]


def test_a_very_long_payload_is_split_into_lanes():
    payload = jpeg.padded(np.random.default_rng(1).integers(0, 256, 3_000_000, dtype=np.uint8).tobytes())
    (image,) = jpeg.decode(jpeg.encode([payload]))
    assert jpeg.payload_of(image) == payload and image.height <= 65535 and image.width <= 65535


def test_files_have_the_markers_of_baseline_jpeg():
    (data,) = jpeg.encode([jpeg.padded(b"hello")])
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    image = jpeg.parse(data)
    assert (image.width, image.height, image.restart, len(image.components)) == (24, 24, 3, 1)
    scan = data[image.scan[0] : -2]
    assert set(re.findall(rb"\xff(.)", scan, re.S)) <= {b"\x00", *(bytes([0xD0 + k]) for k in range(8))}


class Bits:
    """A plain writer of entropy-coded bits, used to make images that `encode` does not make."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def coefficient(self, v):
        n = abs(v).bit_length()
        return n, (v if v > 0 else v + (1 << n) - 1)

    def block(self, values, before):
        n, extra = self.coefficient(int(values[0]) - before)
        self.put(n, 4)
        self.put(extra, n)
        run = 0
        last = max([k for k in range(1, 64) if values[k]], default=0)
        for k in range(1, last + 1):
            if not values[k]:
                run += 1
                continue
            while run > 15:
                self.put(0xF0, 8)
                run -= 16
            n, extra = self.coefficient(int(values[k]))
            self.put(run << 4 | n, 8)
            self.put(extra, n)
            run = 0
        if last < 63:
            self.put(0, 8)

    def bytes(self):
        b = np.array(self.bits + [1] * (-len(self.bits) % 8), np.uint8)
        return np.packbits(b).tobytes().replace(b"\xff", b"\xff\x00")


def test_colour_with_sampling_zero_runs_and_one_interval():
    rng = np.random.default_rng(5)
    dc = jpeg._table(0x00, ((), (), (), tuple(range(12))))
    ac = jpeg._table(0x10, tuple([()] * 7 + [tuple(range(0, 251))]))  # each symbol as its own eight bits
    parts = [(1, 2, 2), (2, 1, 1), (3, 1, 1)]
    across, down, writer, before, expected = 3, 2, Bits(), [0, 0, 0], [[], [], []]
    for _ in range(across * down):
        for c, (_, h, v) in enumerate(parts):
            for _ in range(h * v):
                values = np.zeros(64, int)
                values[0] = rng.integers(-300, 300)
                at = rng.choice(np.arange(1, 64), rng.integers(0, 6), replace=False)
                values[at] = rng.integers(1, 200, len(at)) * rng.choice([-1, 1], len(at))
                writer.block(values, before[c])
                before[c] = int(values[0])
                expected[c].append(values)
    head = b"\xff\xd8" + jpeg._segment(0xDB, b"\x00" + bytes([3]) + b"\x01" * 63) + jpeg._segment(0xC0, b"\x08" + (16 * down - 5).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + b"\x03" + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in parts))
    data = head + jpeg._segment(0xC4, dc + ac) + jpeg._segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + writer.bytes() + b"\xff\xd9"
    (image,) = jpeg.decode([data])
    luma = np.array(expected[0]).reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(2 * down, 2 * across, 64)
    assert (image.coefficients[0] == luma).all() and (image.coefficients[1].reshape(-1, 64) == np.array(expected[1])).all()
    assert (jpeg.thumbnail(image) == np.clip((luma[:, :, 0] * 3 + 4 >> 3) + 128, 0, 255)).all()
    with pytest.raises(ValueError):
        jpeg.decode([b"\xff\xd8" + jpeg._segment(0xC2, bytes(9))])


def test_media_columns_on_edges(spark, edges, none):
    rows = {}
    for r in jpeg.media_columns(edges).collect():
        rows.setdefault(str(r["doc_id"]), r)
    assert jpeg.media_columns(none).count() == 0
    for d, t, *_ in EDGES:
        r, p = rows[str(d)], jpeg.padded((t or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert rows["1"]["feature"] == rows["5"]["feature"] and rows["1"]["media_sha256"] == rows["6"]["media_sha256"]
    media = jpeg.store(edges)
    stored = {str(r["doc_id"]): r["media"] for r in media.collect()}
    assert hashlib.sha256(stored["4"]).hexdigest() == rows["4"]["media_sha256"] and len(stored["4"]) == rows["4"]["media_bytes"]
    seen = jpeg.thumbnails(media.unionByName(spark.createDataFrame([(99, b"no image"), (98, None)], "doc_id bigint, media binary"))).collect()
    assert {r["width"] is None for r in seen if r["doc_id"] in (98, 99)} == {True}
    assert all(r["thumbnail_hash"] in rows[str(r["doc_id"])]["feature"] for r in seen if r["doc_id"] not in (98, 99))


def plain_decode(data):
    """The coefficients of a one-component baseline file, bit by bit: markers, tables and restarts read afresh, in natural order by block."""
    at, tables, interval, quantised = 2, {}, 0, None
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            assert body[0] == 8 and body[5] == 1 and body[7] == 0x11
        elif marker == 0xC4:
            while body:
                counts, code, k, found = body[1:17], 0, 17, {}
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        found[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]], body = found, body[k:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDB:
            quantised = body
        elif marker == 0xDA:
            break
    assert quantised is not None and data[-2:] == b"\xff\xd9"
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[1] if sum(x) % 2 == 0 else x[0]))
    blocks, total = [], -(-high // 8) * -(-wide // 8)
    for scan in re.split(rb"\xff[\xd0-\xd7]", data[at:-2]):
        bits = "".join(f"{b:08b}" for b in scan.replace(b"\xff\x00", b"\xff"))
        k, before = 0, 0

        def symbol(table):
            nonlocal k
            for length in range(1, 17):
                found = table.get((length, int(bits[k : k + length], 2)))
                if found is not None:
                    k += length
                    return found
            raise AssertionError

        def value(n):
            nonlocal k
            k += n
            x = int(bits[k - n : k] or "0", 2)
            return x if not n or x >> n - 1 else x - (1 << n) + 1

        for _ in range(min(interval or total, total - len(blocks))):
            block = [0] * 64
            before += value(symbol(tables[0x00]))
            block[0], i = before, 1
            while i < 64:
                run, size = divmod(symbol(tables[0x10]), 16)
                if not size and run != 15:
                    break
                i += run
                if size:
                    r, c = order[i]
                    block[8 * r + c] = value(size)
                i += 1
            blocks.append(block)
    assert len(blocks) == total
    return np.array(blocks), high, wide


def test_files_are_read_by_an_independent_decoder():
    rng = np.random.default_rng(9)
    for text in (b"", b"hello", "é日本".encode() * 70, rng.integers(0, 256, 2500, dtype=np.uint8).tobytes(), b"\xff" * 1200):
        payload = jpeg.padded(text)
        (data,) = jpeg.encode([payload])
        blocks, high, wide = plain_decode(data)
        (image,) = jpeg.decode([data])
        order = [8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[1] if sum(x) % 2 == 0 else x[0]))]
        scanned = blocks[:, order]  # decode gives coefficients in the order of the scan
        assert (image.coefficients[0].reshape(-1, 64) == scanned).all() and (image.height, image.width) == (high, wide)
        # a coefficient below zero is its byte less 255, one above is the byte
        assert np.where(scanned < 0, scanned + 255, scanned).astype(np.uint8).reshape(-1).tobytes()[: len(payload)] == payload


def test_thumbnail_columns_are_replaced(spark):
    media = spark.createDataFrame([(1, jpeg.encode([jpeg.padded(b"x")])[0], 7, "own")], "doc_id bigint, media binary, Width int, thumbnail_hash string")
    got = jpeg.thumbnails(media)
    assert got.columns == ["doc_id", "media", "width", "height", "thumbnail_hash"] and got.first()["width"] == 24 and jpeg.thumbnails(media.limit(0)).count() == 0


LONG_TEXT = "The cat is on the mat and it was the best of all that we had in the house with a dog and the man who was there for more of it."
PAGE = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var x = "</p><p>no</p>";</script></head><body class="with-sidebar">
<header><p>{LONG_TEXT}</p></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice"><p>{LONG_TEXT}</p></div>
<div id=content><h1>A title</h1><p>{LONG_TEXT} &lt;b&gt; &amp; more&nbsp;of&#32;it.</p><p>Short.</p><!-- <p>hidden</p> --><p>{LONG_TEXT}</p><p><a href="/x">{LONG_TEXT}</a></p></div>
<div class="ad">{LONG_TEXT}</div><section id="comments"><p>{LONG_TEXT}</p></section><form><label>Name</label><textarea>t</textarea></form><aside>{LONG_TEXT}</aside><footer>&copy;</footer></body></html>"""


def test_blocks_of_a_page_without_article():
    assert main_text(PAGE).split("\n") == ["A title", f"{LONG_TEXT} <b> & more of it.", "Short.", LONG_TEXT]


def test_article_wins_over_what_is_outside():
    page = f"<body><p>{LONG_TEXT}</p><article><h1>x</h1><p>Zzyx qqq.</p><div class=share>Share</div><p>Zz <a href=#>yx</a> qqqq qqqq</p></article><p>{LONG_TEXT}</p>"
    assert main_text(page) == "x\nZzyx qqq.\nZz yx qqqq qqqq"


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<html><p>") == main_text("   ") == ""
    assert main_text("<article>a &amp b<br>c<p>un\"closed <p class=\"x>hello</p><p>z</p>").startswith("a & b c\nun\"closed")
    assert main_text("plain text only") == "plain text only"
    assert main_text("<article><p>cut in a ta</p><p>end<fo") == "cut in a ta\nend"
    assert main_text("<article>" + "<p>word " * 20_000).count("\n") == 19_999
    assert main_text("<" * 50_000) is not None and main_text("<a " * 20_000 + '"' * 3) is not None


def test_short_blocks_follow_their_neighbours():
    found = blocks(f"<p>{LONG_TEXT}</p><p>ab</p><p>{LONG_TEXT}</p><p>cd</p><p>{'zz ' * 60}</p><h2>ef</h2><p>{LONG_TEXT}</p>")
    first_pass(found)
    assert [b.label for b in found] == ["good", "short", "good", "short", "bad", "short", "good"]
    assert second_pass(found) == [True, True, True, False, False, True, True]


def test_driver_pages_equal_a_plain_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = extract(pages).collect()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == len(html)
    for r in rows:
        article = html[r["page_id"]].split("<article>", 1)[1].split("</article>")[0]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?h1>|</?p>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_rows_stay(spark):
    df = spark.createDataFrame([(1, None, None, "own"), (None, "u", "", "own"), (2, "u", "<p>hi", "own"), (2, "u", "<p>hi", "own")], "page_id bigint, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in extract(df).collect()) == [("1", "", 0), ("2", "hi", 2), ("2", "hi", 2), ("None", "", 0)]
    assert extract(df.limit(0)).count() == 0


MORE = "It is the one that we had in the house when she was there for the dog."


def test_a_teaser_does_not_take_the_page():
    page = f"<div id=content><p>{LONG_TEXT}</p><p>{LONG_TEXT} {MORE}</p></div><div class='post'><article>Teaser one</article></div><div class='post'><article>Teaser two</article></div>"
    assert main_text(page).startswith(f"{LONG_TEXT}\n{LONG_TEXT} {MORE}")


def test_boiler_words_are_whole_class_names():
    for name in ("comment-enabled", "post share-buttons-on", "no-sidebar", "has-ads-off"):
        assert main_text(f"<article class='{name}'><h1>T</h1><p>{LONG_TEXT}</p></article>") == f"T\n{LONG_TEXT}"
        assert main_text(f"<div class='{name}'><h1>T</h1><p>{LONG_TEXT}</p></div>") == f"T\n{LONG_TEXT}"
    for name in ("comments", "comment-list", "site-header", "share-buttons", "x sidebar_left", "cookie-notice"):
        assert main_text(f"<article><h1>T</h1><p>{LONG_TEXT}</p><div class='{name}'><p>{LONG_TEXT}</p></div></article>") == f"T\n{LONG_TEXT}"
        assert main_text(f"<div><p>{LONG_TEXT}</p></div><div class='{name}'><p>{LONG_TEXT}</p></div>") == LONG_TEXT


def test_a_linked_paragraph_of_an_article_stays_and_a_menu_goes():
    linked = '<p><a href="/x">a source of it</a></p>'
    menu = "<ul>" + "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(5)) + "</ul>"
    assert main_text(f"<article><h1>T</h1><p>{LONG_TEXT}</p>{linked}<p>{MORE}</p>{menu}</article>") == f"T\n{LONG_TEXT}\na source of it\n{MORE}"


def test_open_blocks_ask_their_own_section_first():
    page = f"<div class=menu>x</div><div><h1>A title</h1><p>Short.</p><p>ab</p><p>{LONG_TEXT}</p><p>cd</p><p>ef</p></div><div><a href=/>top</a></div><footer>{LONG_TEXT}</footer>"
    assert main_text(page).split("\n") == ["A title", "Short.", "ab", LONG_TEXT, "cd", "ef"]
    found = blocks(page)
    first_pass(found)
    assert [b.label for b in found] == ["bad", "short", "short", "short", "good", "short", "short", "bad", "bad"]


def test_a_language_without_known_stop_words():
    text = "zyx qwv " * 20
    assert main_text(f"<div><h1>Qq</h1><p>{text}</p><p>{text}</p></div><div><a href=/>aa</a></div>") == "\n".join(["Qq", text.strip(), text.strip()])


def test_main_blocks_stay_without_an_article_tag(spark):
    kept = total = more = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        own = main_text(r["html"]).split("\n")
        other = main_text(r["html"].replace("<article>", "<div>").replace("</article>", "</div>")).split("\n")
        kept += len([b for b in other if b in own])
        more += len([b for b in other if b not in own])
        total += len(own)
    assert kept >= 0.97 * total and more <= 0.01 * total


def test_both_passes_decide_blocks_of_the_pages(spark):
    labels = set()
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        found = blocks(r["html"])
        first_pass(found)
        labels |= {b.label for b in found}
    assert {"good", "bad", "short", "near"} <= labels


def plain_blocks(page):
    """Text, characters in links and section of each block by Python's own HTML parser; for pages that are well nested but for open p and li."""
    from html.parser import HTMLParser

    from keyloft.llm.html import INLINE, RAW, VOID

    out, text, linked, open_, skip = [], [], [], [], 0

    def flush():
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, len(" ".join("".join(linked).split()))))
        text.clear()
        linked.clear()

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            nonlocal skip
            if tag in RAW:
                skip += 1
            elif tag not in INLINE:
                flush()
            elif tag == "br":
                text.append(" ")
            if tag == "a":
                open_.append(tag)

        def handle_endtag(self, tag):
            nonlocal skip
            if tag in RAW:
                skip -= 1
            elif tag not in INLINE and tag not in VOID:
                flush()
            if tag == "a" and open_:
                open_.pop()

        def handle_data(self, data):
            if not skip:
                text.append(data)
                if open_:
                    linked.append(data)

    reader = Reader(convert_charrefs=True)
    reader.feed(page)
    reader.close()
    flush()
    return out


def plain_second_pass(found):
    """Labels of open blocks by looking at every other block."""
    out = []
    for k, b in enumerate(found):
        if b.label in ("good", "bad"):
            out.append(b.label == "good")
            continue
        decided = [j for j, c in enumerate(found) if c.label in ("good", "bad")]
        heads = [j for j, c in enumerate(found) if c.heading and j <= k]

        def sides(same):
            mine = [j for j in decided if not same or found[j].section == b.section]
            top = max([j for j in heads if not same or found[j].section == b.section], default=-1)
            return max([j for j in mine if j < k and j >= top], default=None), min([j for j in mine if j > k], default=None)

        before, after = sides(True)
        if before is None and after is None:
            if b.main and not b.boiler:
                out.append(True)
                continue
            before, after = sides(False)
        if before is None and after is None:
            before = max(j for j in decided if j < k)
        left, right = (None if j is None else found[j].label == "good" for j in (before, after))
        if b.heading and right is not None:
            out.append(right)
        elif left is None or right is None:
            out.append(right if left is None else left)
        elif left == right:
            out.append(left)
        elif b.label == "short" and k - before != after - k:
            out.append(left if k - before < after - k else right)
        else:
            out.append(b.label != "short")
    return out


def test_blocks_equal_those_of_another_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert [(b.text, b.links) for b in blocks(r["html"])] == plain_blocks(r["html"])


def test_second_pass_equals_a_search_of_all_blocks():
    import random

    from keyloft.llm.html import Block

    rnd = random.Random(2)
    for _ in range(500):
        found = []
        for _ in range(rnd.randint(1, 14)):
            b = Block("x", 0, False, rnd.random() < 0.3, rnd.choice(["", "", "", "h2"]), rnd.randint(0, 2))
            b.label = rnd.choice(["good", "bad", "short", "near", "linked"])
            found.append(b)
        if any(b.label == "good" for b in found):
            assert second_pass(found) == plain_second_pass(found)
