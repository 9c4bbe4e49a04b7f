"""Personal data and secrets against plain regular expressions, licence notices, and token counts and pieces."""

import hashlib
import random
import re
import string
import time

import numpy as np

from llm_cases import LONG, ODD, SF, docs_of  # noqa: F401
from logsift.llm import licenses as L
from logsift.llm import pieces as P
from logsift.llm import pii, secrets, tokens
from logsift.llm.common import read_table

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        c = int(c) * (1 + i % 2)
        total += c - 9 * (c > 9)
    return total % 10 == 0


def fits(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
            "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


TRICKY = [(10, "a@b.c%d@e.f x@y 1.2.3.4.5.6.7.8 300.1.1.1 +1 (2) 345 6789 () 4111 1111 1111 1111 é 4111-1111-1111-1111 "
               "+12345678901234567890 é@x.y a@-.b 1.1.1.1@2.2 007.008.09.1 4111111111111112 1 2 3 é日 b@c.d."),
          (11, "1" * 30000), (12, "a@" * 2000), (13, "+1 " * 2000), (14, "9 " * 5000), (15, "x" * 100000 + "@")]


def test_personal_data(spark, docs_of):
    df = read_table(spark, SF, "documents", "doc_id", "text")
    rows = [(r.doc_id + 100, r.text) for r in df.collect()] + ODD + TRICKY
    out = pii.digest(pii.personal_data(docs_of(rows))).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        t = texts[r.doc_id] or ""
        if r.doc_id in (11, 15):
            assert r.spans == ""
            continue
        want = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, t) if fits(k, m.group())]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in PII]
        listed = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(","))


def test_redaction_and_added_spans(spark, docs_of):
    df = read_table(spark, SF, "documents", "doc_id", "text")
    rows = [(r.doc_id + 100, r.text) for r in df.collect()] + [
        (i, f"words around +1 ({i}) 555-{i + 1000} here") for i in range(800, 860)] + [
        (1, "call (988) 555-2485 now, or é a@b.cd"), (2, None), (3, ""), (4, "version 2.0 of 1,000 items")]
    out = {r.doc_id: r.text for r in pii.redacted(docs_of(rows)).collect()}
    assert pii.redacted(docs_of(rows)).columns == docs_of([]).columns
    assert out[1] == "call [PHONE] now, or é [EMAIL]" and out[2] is None and out[3] == "" and out[4] == rows[-1][1]
    assert not any(re.search(PII["email"], t or "") for t in out.values())


PLAIN_TEXTS = ["version 2.0 of 1,000 items on 2024-01-31 and 31.12.2023", "build v10.15.7.1234 took 1234567 steps, 10.5 20.3 30.1",
               "card 4111 1111 1111 1112 fails, 300.1.1.1 too", "user@localhost in 1990-1995"]


def test_a_third_of_the_phones_in_local_form(spark, docs_of):
    df = read_table(spark, SF, "documents", "doc_id", "text")
    rows = [(r.doc_id + 1000, r.text) for r in df.collect()] + list(enumerate(PLAIN_TEXTS, 900)) + [
        (i, f"words around +1 ({800 + i}) 555-{i + 1000} here") for i in range(60)] + [
        (100 + i, f"words around ({900 + i}) 555-{i + 2000} here") for i in range(15)] + [
        (200 + i, f"words around {900 + i}-555-{i + 2000} here") for i in range(15)]
    out = {r.doc_id: r.text for r in pii.redacted(docs_of(rows)).collect()}
    assert {out[i] for i in [*range(60), *range(100, 115), *range(200, 215)]} == {"words around [PHONE] here"}
    assert [out[900 + i] for i in range(4)] == PLAIN_TEXTS


def test_added_spans_of_kinds_without_base_spans(docs_of):
    rows = [(i, f"call ({900 + i}) 555-{i + 2000} or ask jane{i} (at) example.com now") for i in range(30)] + list(enumerate(PLAIN_TEXTS, 900))
    out = {r.doc_id: r.text for r in pii.redacted(docs_of(rows)).collect()}
    assert {out[i] for i in range(30)} == {"call [PHONE] or ask [EMAIL] now"}
    assert [out[900 + i] for i in range(4)] == PLAIN_TEXTS


def test_many_matches_in_one_text(spark):
    """200,000 number groups: base spans equal to plain regexes, in linear time, and a redaction of the whole."""
    rng = random.Random(4)
    shapes = ("+1 (800) 555-18%d", "4111 1111 1111 1111", "192.168.%d.7", "%d.5", "a%d@b.com", "2024-01-%d 12", "(988) 555-24%d")
    text = " ".join(rng.choice(shapes).replace("%d", str(rng.randint(10, 99))) for _ in range(120_000))
    assert len(re.findall("[0-9]+", text)) > 200_000
    start = time.time()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.analysed(df).collect()[0]
    assert time.time() - start < 60
    for kind, p in PII.items():
        want = [(m.start(), m.end()) for m in re.finditer(p, text) if fits(kind, m.group())]
        assert [(x.s, x.e) for x in row[f"base_{kind}"]] == want
    out = pii.redacted(df).collect()[0].text
    assert not re.search(PII["email"], out) and out.count("[EMAIL]") == len(row.base_email)


def test_redaction_of_overlapping_spans(spark):
    rows = [(1, "+1 (800) 192.168.1.11 x 1.1.1.1@2.2 é a@b.cd"), (2, "a@b.cd"), (3, "é 4111 1111 1111 1111 1.2.3.4\U0001f600")]
    out = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = sorted((m.start(), -m.end(), k) for k, p in PII.items() for m in re.finditer(p, t) if fits(k, m.group()))
        want, at = "", 0
        for a, b, k in spans:
            if a >= at:
                want += t[at:a] + f"[{k.upper()}]"
            at = max(at, -b)
        assert out[i] == want + t[at:]


def test_personal_data_of_nothing(docs_of):
    assert pii.personal_data(docs_of([])).count() == 0
    assert [r.spans for r in pii.digest(pii.personal_data(docs_of([(1, "plain words only")]))).collect()] == [""]
    assert [r.text for r in pii.redacted(docs_of([(1, "mail a@b.cd")])).collect()] == ["mail [EMAIL]"]


SECRET = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
          "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def test_secrets(spark, docs_of):
    key = "ghp_16C7e42F292c6912E7710c838347Ae178B4a"
    rows = [(r.doc_id + 100, r.text) for r in read_table(spark, SF, "documents", "doc_id", "text").collect()] + ODD + [
        (10, f"ſecret=abcdefgh PassWord : 'abc.def=' token=short api_key=\"{'0' * 24}\" API-KEY=zzzzzzzz {key} AKIA{'Z9' * 8} AKIA12"),
        (11, "123e4567-e89b-12d3-a456-426614174000 " + "ab12" * 10 + " some/long/path/of_2024/readme-file"), (12, "f" * 200000)]
    out = secrets.digest(secrets.secrets(docs_of(rows))).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        t = texts[r.doc_id] or ""
        want = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(SECRET.items()) for m in re.finditer(p, t, re.I * (i == 0) | re.A)
                      if len(m.group(2) if i == 0 else m.group()) >= (6, 20, 24)[i])
        kinds = list(SECRET)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w[1] == i for w in want) for i in range(3)]
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in out}
    at = texts[10].index(key)
    assert f"token:{at}:{at + len(key)}" in spans[10]
    assert "token" not in spans[11] and "token" not in spans[12]
    assert secrets.digest(secrets.secrets(docs_of([]))).count() == 0


def test_random_strings_of_every_alphabet():
    rng = random.Random(7)
    base32, base36 = string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits
    for letters in (base32, base32.lower(), base36, base36.upper(), string.ascii_letters, string.ascii_uppercase, string.ascii_lowercase):
        for n in (24, 32, 52):
            runs = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(300)]
            found = [secrets.token_spans(list(secrets.RUN.finditer(f"seed {r} here"))) for r in runs]
            assert sum(f == [(5, 5 + n)] for f in found) >= 0.97 * len(runs), (letters, n)
    for plain in ("some/long/path/of_2024/readme-file", "ThisIsALongCamelCaseIdentifierName", "internationalization-and-localization",
                  "CONFIGURATION_DIRECTORY_NAME", "12345678901234567890123", "--------------------------", "a" * 40):
        assert secrets.token_spans(list(secrets.RUN.finditer(plain))) == [], plain


def test_license_notices(spark, docs_of):
    mit = L.TEMPLATES["mit-notice"]
    changed = mit.replace("free of charge", "at no cost").replace("Software", "Program", 1)
    rows = ODD + [(10, "words before. Licensed under CC BY-NC 4.0. and after"), (11, "x " * 500 + changed + " y" * 500),
                  (12, "All rights reserved. text All rights reserved."), (13, "rights are all we have reserved"),
                  (14, "released, under  THE mit-License! " + L.TEMPLATES["isc"]), (15, (mit + " ") * 30)]
    out = {r.doc_id: r for r in L.digest(L.license_notices(docs_of(rows))).collect()}
    names = {k: [p.rsplit(":", 2)[0] for p in r.places.split(",")] if r.places else [] for k, r in out.items()}
    assert all(names[k] == [] for k in (1, 2, 3, 4, 5, 6, 13))
    assert names[10] == ["cc-by-nc-4.0"] and out[10].places == "cc-by-nc-4.0:2:9" and out[10].coverage == 1.0
    assert names[11] == ["mit-notice"] and 0.9 < out[11].coverage < 1
    assert out[12].n_notices == 2 and names[12] == ["all-rights-reserved"] * 2
    assert names[14] == ["mit", "isc"] and names[15] == ["mit-notice"] * 30
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Released under the MIT License.": "mit",
             "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "All rights reserved.": "all-rights-reserved",
             "Licensed under the Apache License, Version 2.0.": "apache-2.0"}
    df = read_table(spark, SF, "documents", "doc_id", "text")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in L.digest(L.license_notices(df)).collect():
        found = {p.rsplit(":", 2)[0] for p in r.places.split(",")} if r.places else set()
        assert found == {n for line, n in lines.items() if line in texts[r.doc_id]}


def test_patience_alignment():
    assert L.increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3]) and L.increasing([]) == []
    a, b = np.array([9, 1, 2, 2, 3, 8]), np.array([1, 2, 2, 3])
    assert L.align(a, b) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    rng = np.random.default_rng(0)
    for _ in range(50):     # an alignment is increasing on both sides and joins equal words
        a, b = rng.integers(0, 6, 12), rng.integers(0, 6, 9)
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


HUGE = ["x" * 90000, "a " * 60000, "é" * 70000 + " b" * 9000, "<|endoftext|> hi" * 8000, "\x1c á Σ b" * 12000,
        "ab" * 40000 + " " + "cd " * 9000, LONG]


def test_token_counts(spark, docs_of):
    tok = tokens.tokenizer(tokens.VOCABULARY)
    rows = ODD + list(enumerate(HUGE, 20)) + [
        (r.doc_id + 100, r.text) for r in read_table(spark, SF, "documents", "doc_id", "text").collect()]
    out = tokens.token_counts(docs_of(rows)).collect()
    assert len(out) == len(rows)
    want = {i: (len((t or "").encode()), len(tok.lib.encode(t or "", add_special_tokens=False))) for i, t in rows}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in out} == want
    assert tokens.token_counts(docs_of([])).count() == 0


def test_resynchronisation_with_other_vocabularies():
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        tok = tokens.tokenizer(name)
        for text in HUGE[1:5] + [LONG]:
            for chunk, overlap in ((4096, 16), (700, 512)):
                assert tokens.count_huge(text[:30000], tok, chunk, overlap) == len(tok.encode(text[:30000])[0])


def brute_pieces(model, text):
    """Best score by trying every piece that starts at every place."""
    scores = {p: (s, i) for p, (_, s, i) in model.automaton.items()}
    best = [(0.0, ())] + [(-1e18, ())] * len(text)
    for a in range(len(text)):
        for b in range(a + 1, min(len(text), a + 20) + 1):
            if text[a:b] in scores:
                s, i = scores[text[a:b]]
                best[b] = max(best[b], (best[a][0] + s, best[a][1] + (i,)), key=lambda x: x[0])
        if best[a][0] + model.no_piece > best[a + 1][0]:
            best[a + 1] = (best[a][0] + model.no_piece, best[a][1] + tuple(model.byte[c] for c in text[a].encode()))
    return best[-1]


def test_pieces(spark, docs_of):
    model = P.pieces(P.MODEL)
    score = {i: s for _, (_, s, i) in model.automaton.items()}
    odd = ["  a  b \n\n c ", "a▁b", "\n", " ", "日本語 テスト", "a\n b", "x  \n", "\x00\x01", "the" * 500]
    single = {p for p in model.automaton.keys() if len(p) == 1}
    docs = read_table(spark, SF, "documents", "doc_id", "text").collect()
    for t in odd + [r.text[:300] for r in docs[:25]]:
        form = P.BLANK + t.replace(" ", P.BLANK)
        whole = model.viterbi(form)
        assert np.frombuffer(model.encode(t), np.int32).tolist() == whole
        want, _ = brute_pieces(model, form)
        mine = sum(score.get(i, 0.0) for i in whole) + sum(c not in single for c in form) * model.no_piece
        assert abs(mine - want) <= 1e-9 * abs(want)
        assert model.decode(model.encode(t)) == t.replace(P.BLANK, " ")
    rows = ODD + [(r.doc_id + 100, r.text) for r in docs]
    out = P.round_trip(docs_of(rows)).collect()
    assert len(out) == len(rows) and all(r.same for r in out)
    assert {r.doc_id: r.n_pieces for r in out}[1] == 0
    ids = P.encoded(docs_of(rows))
    back = {r.doc_id: r.text for r in P.decoded(ids).collect()}
    assert back == {i: (t or "").replace(P.BLANK, " ") for i, t in rows}
    assert P.encoded(docs_of([])).count() == 0


def _lcs_to_all_ends(a, first, b):
    """Length of a longest common subsequence of b and a[first:e], for each e after first."""
    row, out = [0] * (len(b) + 1), []
    for w in a[first:]:
        new = [0]
        for j, v in enumerate(b):
            new.append(row[j] + 1 if w == v else max(row[j + 1], new[j]))
        row = new
        out.append(row[-1])
    return out


def test_license_stretches_against_all_windows():
    rng = np.random.default_rng(3)
    hits = crossed = 0
    for case in range(1000):
        size, filler = int(rng.integers(2, 9)), int(rng.integers(0, 3))
        t = L.Templates({"t": " ".join(f"w{x}" for x in rng.integers(0, 5, size))})
        sequence, need, span = t.sequences[0], t.need[0], size * t.stretch[0]
        text = rng.integers(0, len(t.words) + filler, int(rng.integers(1, 40)))     # numbers past the vocabulary are filler
        if case % 3 == 0:                                                           # an edited notice within
            text = np.concatenate([text[:9], np.where(rng.random(size) < 0.1, 99, sequence), text[9:]])
        place = np.flatnonzero(text < len(t.words))
        found = L.notices(place, text[place], t, [0])
        words, b = text.tolist(), sequence.tolist()
        for s in range(len(words)):
            for n, common in enumerate(_lcs_to_all_ends(words, s, b)[:span], 1):
                if common >= need:      # whatever covers enough meets a notice
                    assert any(s < y and x < s + n for x, y, _, _ in found), (words, b, found, s, n)
                    hits += 1
        for x, y, _, coverage in found:
            assert y - x <= span and round(coverage * size) == _lcs_to_all_ends(words[:y], x, b)[-1] >= need
            assert words[x] in b and words[y - 1] in b
            crossed += len(L.align(text[x:y], sequence)) < round(coverage * size)
        assert all(p[1] <= q[0] for p, q in zip(found, found[1:]))
    assert hits > 1000 and crossed > 0


def test_license_notices_in_hard_places():
    t = L.Templates(L.TEMPLATES)
    rng = np.random.default_rng(5)
    all_of = range(len(t.names))
    for name, sequence in zip(t.names, t.sequences):        # each template is itself, once, whole
        assert L.notices(np.arange(len(sequence)), sequence, t, all_of) == [(0, len(sequence), name, 1.0)]
    mit = t.sequences[t.names.index("mit-notice")]
    for _ in range(20):     # 15 % of the words replaced, and shuffled words of the same notice before and behind
        kept = np.sort(rng.choice(len(mit), int(np.ceil(0.85 * len(mit))), replace=False))
        shuffled = rng.permutation(mit)
        place = np.concatenate([np.arange(len(mit)), len(mit) + kept, 2 * len(mit) + np.arange(len(mit))])
        (a, b, name, coverage), = L.notices(place, np.concatenate([shuffled, mit[kept], rng.permutation(mit)]), t, all_of)
        assert name == "mit-notice" and coverage >= 0.85
        assert abs(a - len(mit) - kept[0]) <= 8 and abs(b - len(mit) - kept[-1] - 1) <= 8
    assert L.notices(np.arange(len(mit)) * 3, mit, t, all_of) == [(0, 3 * len(mit) - 2, "mit-notice", 1.0)]     # two fillers a word
    began = time.perf_counter()
    assert L.notices(np.arange(100_000), rng.choice(mit, 100_000), t, all_of) == []
    assert time.perf_counter() - began < 60


def test_plans_of_the_fit_stay_small(spark, monkeypatch):
    """Every plan is printed on the driver, some again and again: the largest was half a megabyte of text."""
    sizes = {}
    keep = pii.materialize

    def measured(df, name):
        sizes[name] = len(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(pii, "materialize", measured)
    monkeypatch.setattr(pii, "_seed_rows", [], raising=False)
    docs = spark.createDataFrame([(1, "mail a.b@example.com or call +49 30 901820")], "doc_id long, text string")
    assert pii.personal_data(docs).count() == 1
    assert "proposals" in sizes and max(sizes.values()) < 100_000, sizes
    seeds = len(pii._seed_rows)
    sizes.clear()
    assert pii.redacted(docs).count() == 1          # the seeds are counted once
    assert "seeds" not in sizes and len(pii._seed_rows) == seeds > 0
