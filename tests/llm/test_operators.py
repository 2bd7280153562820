"""Small tables against brute force, and the defined odd cases of every operator."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from claimloom.llm import decontaminate, jpeg, langid, line_dedup, mixing, near_dedup, pii, quality, token_store, toxicity

random.seed(7)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(400)]


def text(n, words=WORDS):
    return " ".join(random.choice(words) for _ in range(n))


# -- 1
def test_pii_surrogates(make):
    key = b"k"
    rows = [
        (1, "Mail Bob.Smith@mail8.example.com, call +1 (988) 555-2485 or 1-988-555-2485."),
        (2, "bob.smith@mail8.example.com wrote; card 4111 1111 1111 1111, ip 10.1.2.3"),
        (3, "Mr John Smith met Mrs Anna Smith. password=b7db7aa4a5fcc78305"),
        (4, "г-жа Ольга Иванова, DE89370400440532013000, 1999-2001, v2.0"),
    ]
    out = {r["doc_id"]: r for r in pii.pseudonymize(make(rows), key).collect()}
    for i, t in rows:
        for a, b, _, _ in pii.find(t):
            assert t[a:b] not in out[i]["text"]
        for e in out[i]["entities"]:
            assert out[i]["text"][e["start"] : e["end"]]
    mail = [out[i]["text"][e["start"] : e["end"]] for i in (1, 2) for e in out[i]["entities"] if e["type"] == "email"]
    assert mail[0].lower() == mail[1].lower() and mail[0].endswith(".com") and mail[0][0].isupper()
    phones = ["".join(c for c in out[1]["text"][e["start"] : e["end"]] if c.isdigit())[-10:] for e in out[1]["entities"] if e["type"] == "phone"]
    assert len(phones) == 2 and phones[0] == phones[1]
    card = next("".join(c for c in out[2]["text"][e["start"] : e["end"]] if c.isdigit()) for e in out[2]["entities"] if e["type"] == "card")
    assert card[-1] == str(pii.luhn(card[:-1])) and card[0] == "4"
    people = [out[3]["text"][e["start"] : e["end"]] for e in out[3]["entities"] if e["type"] in ("given", "family")]
    assert people[1] == people[3] and people[0] in pii._GIVEN["LATIN", "m"] and people[2] in pii._GIVEN["LATIN", "f"]
    assert pii.script(out[4]["text"][out[4]["entities"][0]["start"] :]) == "CYRILLIC" and "1999-2001" in out[4]["text"]


def test_pii_keeps_entities_apart(make):
    families = ["Zz" + "".join(random.choice("abcdef") for _ in range(6)) for _ in range(120)]
    rows = [(i, f"Mr {f} and card {4000000000000000 + i}") for i, f in enumerate(families)]
    out = pii.pseudonymize(make(rows), b"k").collect()
    new = [r["text"][e["start"] : e["end"]] for r in out for e in r["entities"]]
    assert len(set(new)) == len(new) and not set(new) & set(families)
    assert sorted(pii.permute(x, 1000, b"k", "t") for x in range(1000)) == list(range(1000))


# -- 2
def brute_hits(docs, items, span=10):
    split = lambda t: [w for w in __import__("re").split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item, it in items:
            v = split(it)
            n = min(span, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_decontaminate(spark, make):
    items = [(i, text(n)) for i, n in enumerate((25, 14, 10, 9, 4, 1, 0))] + [(7, None), (8, text(12))]
    docs = [(i, text(60, WORDS[:30])) for i in range(12)]
    docs += [(20 + k, text(20) + " " + (t or "").upper() + ", " + text(9)) for k, (_, t) in enumerate(items)]
    docs += [(40, " ".join(items[0][1].split()[3:13])), (41, " ".join(items[0][1].split()[3:12])), (42, None), (43, "")]
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, h string")
    got = decontaminate.find_benchmark_spans(make(docs), bench)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()) == sorted(brute_hits(docs, items))
    kept = decontaminate.decontaminate(make(docs), bench)
    assert kept.columns == make(docs).columns and {r["doc_id"] for r in kept.collect()} == {d for d, _, h, _ in brute_hits(docs, items) if not h}
    assert decontaminate.find_benchmark_spans(make(docs), bench.limit(0)).where("contaminated").count() == 0


# -- 3
def test_near_dedup(make):
    base = text(300).split()
    docs = [(0, " ".join(base)), (1, " ".join(base).upper()), (2, None), (3, ""), (4, "one two"), (5, "One  two"), (None, " ".join(base))]
    for i in range(6, 60):
        w = list(base)
        for _ in range(random.randint(0, 9)):
            w[random.randrange(len(w))] = random.choice(WORDS)
        docs.append((i, " ".join(w)))
    sets = {i: set(near_dedup.shingle_set(t.encode()).tolist()) if t else set() for i, t in docs if i is not None}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.link_near_duplicates(make(docs)).collect()}
    assert {i: got[i] for i in sets} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets} and got[None][1:] == (None, True)
    kept = near_dedup.keep_one(make(docs))
    assert kept.columns == make(docs).columns and {r["doc_id"] for r in kept.collect()} == {i for i in label if label[i] == i} | {None}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["label"] for r in near_dedup.components(links)[0].collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# -- 4, 6, 9
def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def held(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def test_quality(spark, make):
    docs = [(i, text(80) if i % 2 else " ".join(w + "***" for w in text(80).split())) for i in range(300)]
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(300)])
    model = quality.fit_quality(make(docs), labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(make(docs), model).collect()}
    tested = [i for i in got if held(i, 5) == 0]
    assert tested and all((got[i] >= 0.3) == (i % 2 == 1) for i in tested)
    none = quality.fit_quality(make(docs), labels.limit(0))
    assert {r["score"] for r in quality.score_quality(make(docs[:3]), none).collect()} == {0.5}


def test_toxicity(spark, make):
    bad = ["vilezza", "grubnak", "grubnok", "trollop"]
    docs = [(i, text(60) + (" " + " ".join(random.sample(bad, 3)) + " " if i % 3 == 0 else " ") + text(40)) for i in range(400)]
    labels = labels_of(spark, [(i, None, int(i % 3 == 0)) for i in range(400)])
    model = toxicity.fit_toxicity(make(docs), labels)
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(make(docs), model).collect()}
    tested = [i for i in rows if held(i, 5) == 0]
    assert all((rows[i]["score"] >= 0.5) == (i % 3 == 0) for i in tested)
    first = next(i for i in tested if i % 3 == 0)
    assert any(p["first"] <= 60 < p["end"] for p in rows[first]["passages"])
    kept = toxicity.drop_toxic(make(docs), model)
    assert kept.columns == make(docs).columns and kept.count() == sum(r["score"] < 0.5 for r in rows.values())
    assert toxicity.fit_toxicity(make(docs), labels.limit(0)).score("x") == 0.5


def brute_segments(s):
    """Maximal segments by their definition: the best one, then the same left and right of it."""
    best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    a, b = best[2], best[3]
    return brute_segments(s[:a]) + [(a, b, best[0])] + [(x + b, y + b, z) for x, y, z in brute_segments(s[b:])]


def test_segments():
    for _ in range(200):
        s = [random.choice((-1, -2, -3, 1, 2, 4)) + random.random() / 7 for _ in range(random.randint(0, 14))]
        got = toxicity.segments(np.array(s), 1.0)
        want = brute_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_languages(make):
    voices = {"aa": [w for w in WORDS if "a" in w][:60], "bb": [w.translate(str.maketrans("abcdefghij", "klmnopqrst")) for w in WORDS[:60]]}
    docs = [(i, text(40, voices["aa" if i % 2 else "bb"]), "aa" if i % 2 else "bb") for i in range(120)] + [(200, None), (201, "123 !"), (202, "", None)]
    df = make(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify_languages(df, langid.fit_languages(df)).collect()}
    assert all(got[i][0] == lang for i, _, lang in docs[:120] if held(i, 4) == 2)
    assert got[200] == got[201] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    nobody = langid.fit_languages(df.where("lang = 'zz'"))
    assert {r["lang_pred"] for r in langid.identify_languages(df, nobody).collect()} == {"und"}


def brute_phrases(own, symbols):
    """Greedy longest matches of ``symbols`` in ``own``; a symbol that is not there is a phrase."""
    phrases, at = 0, 0
    while at < len(symbols):
        n = 0
        while at + n < len(symbols) and symbols[at : at + n + 1] in own:
            n += 1
        phrases, at = phrases + 1, at + max(n, 1)
    return phrases


def test_longest_matches_of_the_automaton():
    own = "abracadabra " * 3 + " Жук жук ёж" + text(300)
    parser = langid.LanguageParser({"x": own}, {"x": 1}, 100_000)
    texts = ["abra", "cadzzab", "brabra", "xyz", "rac adab", "", "жёжук", "中文abra", text(2000), own[3:] * 5, "q" * 700, "ab" * 700]
    found = [langid.letters(t)[0] for t in texts]
    got = parser.phrases(found)[:, 0].tolist()
    assert got == [brute_phrases(langid.letters(own)[0], f) for f in found]


def test_letters_beyond_any_number_are_told_apart(make):
    """Two languages in one script of thousands of letters, of which the rare ones differ."""
    common, left, right = [chr(0x4E00 + k) for k in range(300)], [chr(0x5500 + k) for k in range(800)], [chr(0x6600 + k) for k in range(800)]
    rng = random.Random(2)
    docs = [(i, "".join(rng.choices(common, k=20) + rng.choices(left if i % 2 else right, k=60)), "l" if i % 2 else "r") for i in range(400)]
    df = make(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(df, langid.fit_languages(df)).collect()}
    tested = [d for d in docs if held(d[0], 4) == 2]
    assert sum(got[i] == lang for i, _, lang in tested) >= 0.98 * len(tested)


# -- 5
def test_mixing(make):
    docs = [(i, text(20 + i % 7), "de" if i % 5 == 0 else "en", f"s{i % 3 if i % 4 else 0}") for i in range(2000)]
    from pyspark.sql import functions as F

    wanted = {"s0": 0.2, "s1": 0.4, "s2": 0.4}
    rows = mixing.mix(make(docs), F.lit("t"), source_targets=wanted, lang_targets={"en": 0.5, "de": 0.5}, keep=0.3).collect()
    mass, cell = collections.Counter(), {(r["source"], r["lang"]): r["weight"] for r in rows}
    for (s, lang), w in cell.items():
        mass[s] += w
        mass[lang] += w
    assert all(abs(mass[k] - v) < 1e-6 for k, v in (wanted | {"en": 0.5, "de": 0.5}).items())
    tokens = sum(r["n_tokens"] for r in rows)
    assert abs(sum(r["n_tokens"] * r["probability"] for r in rows) - 0.3 * tokens) < 1e-6 * tokens
    assert abs(sum(r["n_tokens"] for r in rows if r["kept"]) - 0.3 * tokens) < 0.05 * tokens
    again = mixing.mix(make(docs), F.lit("t"), source_targets=wanted, lang_targets={"en": 0.5, "de": 0.5}, keep=0.3).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in rows) == sorted((r["doc_id"], r["kept"]) for r in again)


# -- 7
def encode_test_image(blocks, across, down, parts, interval=0):
    """A plain baseline encoder: blocks of quantised coefficients per unit, in scan order."""
    dc = {n: (n, 4) for n in range(12)}
    ac = {0x00: (0, 8), 0xF0: (1, 8)} | {r << 4 | s: (2 + r * 10 + s - 1, 8) for r in range(16) for s in range(1, 11)}
    value = lambda v, n: v if v > 0 else v + (1 << n) - 1

    def put(lane):
        bits, last = "", collections.Counter()
        for part, coefficients in lane:
            d = coefficients[0] - last[part]
            last[part] = coefficients[0]
            n = abs(d).bit_length()
            bits += f"{dc[n][0]:04b}" + (f"{value(d, n):0{n}b}" if n else "")
            run, rest = 0, coefficients[1:]
            while rest and rest[-1] == 0:
                rest = rest[:-1]
            for c in rest:
                if c == 0:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + f"{ac[0xF0][0]:08b}", run - 16
                n = abs(c).bit_length()
                bits, run = bits + f"{ac[run << 4 | n][0]:08b}" + f"{value(c, n):0{n}b}", 0
            if len(rest) < 63:
                bits += f"{ac[0][0]:08b}"
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    per = len(blocks) if not interval else interval
    lanes = [blocks[i : i + per] for i in range(0, len(blocks), per)]
    scan = b"".join(put([b for unit in lane for b in unit]) + (bytes([0xFF, 0xD0 + k % 8]) if k < len(lanes) - 1 else b"") for k, lane in enumerate(lanes))
    frame = b"\x08" + down.to_bytes(2, "big") + across.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts))
    return (
        b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([16] + [1] * 63)) + seg(0xC0, frame)
        + seg(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + seg(0xC4, b"\x10" + bytes([0] * 7 + [len(ac)] + [0] * 8) + bytes(ac))
        + (seg(0xDD, interval.to_bytes(2, "big")) if interval else b"") + seg(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + b"\0\x3f\0") + scan + b"\xff\xd9"
    )


@pytest.mark.parametrize("interval", [0, 2])
def test_jpeg_reader_on_colour_and_ac(interval):
    random.seed(3)
    block = lambda: [random.randint(-60, 60)] + [random.choice((0, 0, 0, 0, 1, -3, 200)) if random.random() < 0.3 else 0 for _ in range(63)]
    units = [[(0, block()), (0, block()), (0, block()), (0, block()), (1, block()), (2, block())] for _ in range(6)]  # 3 x 2 units of 16 x 16
    media = encode_test_image(units, 41, 30, [(2, 2), (1, 1), (1, 1)], interval)
    (thumb,) = jpeg.thumbnails(jpeg.parse(media))
    assert thumb.shape == (4, 6)
    for u, unit in enumerate(units):
        for k in range(4):
            want = min(255, max(0, ((unit[k][1][0] * 16 + 4) >> 3) + 128))
            assert thumb[u // 3 * 2 + k // 2, u % 3 * 2 + k % 2] == want


def test_jpeg_round_trip_and_errors(spark, odd):
    payloads = [jpeg.pad(x) for x in (b"", b"a", bytes(range(256)) * 1000, b"\xff" * 600, "é".encode() * 999)]
    for p, m in zip(payloads, jpeg.write_images(payloads), strict=True):
        assert b"".join(t.tobytes() for t in jpeg.thumbnails(jpeg.parse(m))) == p
    good = jpeg.write_images(payloads[1:2])[0]
    frame = good.index(b"\xff\xc0")  # marker, size, bits, height, width, parts, then (id, sampling, quantiser)
    no_sampling, huge = good[: frame + 11] + b"\0" + good[frame + 12 :], good[: frame + 5] + b"\xff\xff\xff\xff" + good[frame + 9 :]
    bad = [good, None, b"", b"no", good[:200], good[:-40], good.replace(b"\xff\xc0", b"\xff\xc2"), no_sampling, huge, *(good[:k] + bytes([good[k] ^ 0x55]) + good[k + 1 :] for k in (frame + 3, frame + 9, frame + 10))]
    rows = jpeg.describe_media(spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(bad)], "id long, content binary")).orderBy("id").collect()
    assert rows[0]["error"] is None and (rows[0]["width"], rows[0]["height"]) == (192, 192) and all(r["error"] for r in rows[1:])
    got = jpeg.read_digests(jpeg.store_texts(odd)).collect()
    for r in got:
        assert r["payload_bytes"] % 576 == 0 and r["payload_bytes"] >= 576
    by = {r["doc_id"]: r for r in got}
    assert by[3]["payload_sha256"] == by[2]["payload_sha256"] == hashlib.sha256(b"\xff" * 576).hexdigest()


# -- 8
def test_token_files(spark, odd, make):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tricky = ["don't STOP", "Élan, œuvre!?", "ΣΟΦΟΣ", "a\x1cb x", "<|endoftext|> <|EndOfText|>", "é KK", "12,5.x_y", "中文 字", "it's l'été"]
    df = odd.union(make([(100 + i, t) for i, t in enumerate(tricky)]))
    path = token_store.write_token_files(df, "word_bpe_49k.json", shard_tokens=50)
    got = sorted(token_store.read_token_files(spark, path, token_store.ids_crc32, "ids_crc32 long").collect(), key=lambda r: r["start"])
    at = 0
    for r, row in zip(got, sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = tok.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        assert tuple(r) == (row["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_chunks_as_the_tokenizer(most):
    """Ids of chunks, joined, are the ids of the whole text, also when few chunks are kept."""
    pytest.importorskip("public_tokenizers")
    encoder = token_store.ChunkEncoder("word_bpe_49k.json", "<u2", most)
    texts = ["it's! don't,, l'\u00e9t\u00e9. \u00c9t\u00e9, \u00c0B;c x\u2014y a.b a'. 'a '' \x0b\x0c\x1c z q", "\u0130X \u1e9e \u00df, \u00ff\u0178 \u0229\u0301,", "a_b,__ 12,3. <b>|", "<|endoftext|> x", "", " ", "\u00c9. \u00c9 ... \u00aa \u00ba, \u00b5 \u00d7a", "one two one, two. one two three"]
    for text in texts * 2:
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_tokenizer_of_another_kind(spark, make):
    """One that keeps the case and the blanks: its texts are not cut into words."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert not token_store.by_words(tok) and token_store.by_words(Tokenizer.from_file(public.path("word_bpe_49k.json")))
    texts = ["Some Words  of TEXT, again Some", " leading", "é中\n\nx", "", None]
    path = token_store.write_token_files(make(list(enumerate(texts))), "byte_bpe_50k.json")
    got = {r["id"]: r["ids"] for r in token_store.read_token_files(spark, path, np.ndarray.tolist, "ids array<long>").collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}


def test_token_files_stand_alone(spark, make, tmp_path):
    """Another process reads the folder, with nothing of this one."""
    import subprocess
    import sys

    path = token_store.write_token_files(make([(1, "one two"), (2, "two three two")]), "word_bpe_49k.json", str(tmp_path / "store"))
    code = f"""
from pyspark.sql import SparkSession
from claimloom.llm import token_store
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("got", sorted(map(tuple, token_store.read_token_files(spark, {path!r}, token_store.ids_crc32, "c long").collect())))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    want = sorted(map(tuple, token_store.read_token_files(spark, path, token_store.ids_crc32, "c long").collect()))
    assert f"got {want}" in out.stdout and len(want) == 2


def test_numbers():
    n = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7, 3], np.uint32)
    assert (token_store.decode_numbers(*token_store.encode_numbers(n), len(n)) == n).all() and len(token_store.decode_numbers(b"", b"", 0)) == 0
    assert [x.tolist() for x in token_store.unpack_shard(token_store.pack_shard([n[:2], n[:0], n[2:]]))] == [n[:2].tolist(), [], n[2:].tolist()]
    with pytest.raises(ValueError):
        token_store.unpack_shard(b"xxxx" + token_store.pack_shard([n])[4:])


# -- 10
def test_line_dedup(make):
    long_ = "This line is long enough to be found again " * 2
    docs = [(i, f"  {long_}\nown {i}\n{long_.upper()}\nshort") for i in range(6)] + [(6, None), (7, ""), (None, long_), (8, long_.replace("long", "other"))]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(make(docs)).collect()}
    assert all((got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == (4, 2, f"own {i}\nshort") for i in range(5))
    assert got[5]["n_dropped"] == 0 and (got[6]["n_lines"], got[6]["kept_text"]) == (1, "") and got[None]["kept_text"] == long_


# -- every operator
def test_odd_tables(spark, odd):
    labels = labels_of(spark, [(1, 1, 0), (3, 0, 1), (5, None, None), (None, 1, 1)])
    bench = spark.createDataFrame([(1, "plain text of a few words"), (None, None)], "item_id long, text string")
    runs = {
        "pii": lambda d: pii.pseudonymize(d, b"k"),
        "bench": lambda d: decontaminate.find_benchmark_spans(d, bench),
        "near": near_dedup.link_near_duplicates,
        "quality": lambda d: quality.score_quality(d, quality.fit_quality(d, labels)),
        "mix": mixing.mix,
        "toxic": lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)),
        "jpeg": lambda d: jpeg.read_digests(jpeg.store_texts(d)),
        "lang": lambda d: langid.identify_languages(d, langid.fit_languages(d)),
        "lines": line_dedup.dedup_lines,
    }
    for name, run in runs.items():
        assert run(odd).count() == odd.count(), name
        assert run(odd.limit(0)).count() == 0, name
    for run in (near_dedup.keep_one, mixing.draw_mixture, lambda d: decontaminate.decontaminate(d, bench)):
        assert run(odd).columns == odd.columns and run(odd.limit(0)).count() == 0
    path = token_store.write_token_files(odd.limit(0), "word_bpe_49k.json")
    assert token_store.read_token_files(spark, path, token_store.ids_crc32, "c long").count() == 0
