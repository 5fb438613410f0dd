import itertools
import random
import re

from shardsort.llm import licenses
from shardsort.llm.common import table

UPPER = {c: c + 32 for c in range(65, 91)}
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def longest(words, i, texts):
    """Matching statistic by brute force: the longest suffix of words[:i + 1] that stands in a text."""
    for n in range(i + 1, 0, -1):
        part = words[i - n + 1 : i + 1]
        if any(t[j : j + n] == part for t in texts for j in range(len(t) - n + 1)):
            return n
    return 0


def test_automaton_gives_matching_statistics_and_places():
    rng = random.Random(5)
    for _ in range(60):
        texts = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        a = licenses.SuffixAutomaton(texts)
        state = matched = 0
        words = [rng.randrange(5) for _ in range(40)]
        for i, word in enumerate(words):
            while state and word not in a.step[state]:
                state = a.link[state]
                matched = a.length[state]
            if word in a.step[state]:
                state, matched = a.step[state][word], matched + 1
            assert matched == longest(words, i, texts)
            if matched:
                part = words[i - matched + 1 : i + 1]
                assert a.ends[state] == {(k, j + matched - 1) for k, t in enumerate(texts) for j in range(len(t) - matched + 1) if t[j : j + matched] == part}


def test_base_hits_of_the_tables(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    found = 0
    for r in licenses.labelled(docs).collect():
        n, places, first, last, labels = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, places, first, last, labels)
        assert set(labels.split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        found += places
    assert found


def test_random_phrases_overlap_and_repeat(spark):
    rng = random.Random(7)
    pool = "under the mit license apache version 2 cc by nc x licensed 4 0 file".split()
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for k in range(300)]
    rows += [(900, "CC BY NC cc-by-nc CC BY\nNC by nc"), (901, "Under the MIT\tLicense, under the mit license")]
    got = {r["doc_id"]: r for r in licenses.labelled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        assert (got[k]["n_words"], got[k]["n_base"], got[k]["first_word"], got[k]["last_word"], got[k]["base_labels"]) == brute(text), text


def test_notices_are_covered(spark):
    notice = dict(licenses.NOTICES)["bsd"]
    words = notice.split()
    cut = " ".join(words[:10] + ["CHANGED"] + words[11:])
    rows = [(1, f"Intro. {notice.title()}! Outro."), (2, cut), (3, " ".join(words[:8])), (4, " ".join(reversed(words))), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "no licence")]
    got = {r["doc_id"]: r for r in licenses.labelled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in range(1, 7)] == ["bsd", "bsd", "", "", "gpl", ""]
    assert got[1]["score"] == 1.0 and 0.75 <= got[2]["score"] < 1 and got[6]["score"] == 0.0 and got[5]["n_base"] == 0
    span = licenses.scan(spark.createDataFrame(rows[:1], "doc_id long, text string")).head()["spans"][0]
    assert (span["first_word"], span["last_word"]) == (1, len(words))


def test_awkward_documents(docs, rows, no_docs):
    got = licenses.labelled(docs).collect()
    assert len(got) == len(rows) and all(r["n_words"] == 0 for r in got if r["n_base"] == 0 and r["doc_id"] in (27, 28, 29))
    assert licenses.labelled(no_docs).count() == 0 and licenses.scan(docs).columns == [c for c in docs.columns if c != "text"] + ["words", "places", "spans"]


def every_match(words, notice, least):
    """Matches by brute force: a stretch that stands in some text and cannot be extended to either side there."""
    out = []
    for i in range(len(words)):
        for j in range(i + least, len(words) + 1):
            part = words[i:j]
            for at in range(len(notice) - len(part) + 1):
                if notice[at : at + len(part)] == part:
                    out.append(licenses.Match(i, j, at))
    return out


def brute_spans(matches, size, gap, coverage):
    """Every set of matches is tried as a chain, and every set of chains as the spans."""
    chains = {}
    for n in range(1, len(matches) + 1):
        for chain in itertools.combinations(matches, n):
            covered, fits = chain[0].end - chain[0].begin, True
            for a, b in itertools.pairwise(chain):
                shared = max(0, a.end - b.begin, a.start + a.end - a.begin - b.start)
                fits &= a.begin < b.begin and a.end < b.end and a.start < b.start and a.start + a.end - a.begin < b.start + b.end - b.begin
                fits &= b.begin - a.end <= gap and shared < b.end - b.begin
                covered += b.end - b.begin - shared
            if fits:
                last = chain[-1]
                chains[last] = max(chains.get(last, (0, 0)), (covered, chain[0].begin))
    good = sorted({(first, m.end, covered) for m, (covered, first) in chains.items() if covered >= coverage * size})
    most = 0
    for n in range(1, len(good) + 1):
        for some in itertools.combinations(good, n):
            if all(a[1] <= b[0] for a, b in itertools.pairwise(some)):
                most = max(most, sum(c for _, _, c in some))
    return most, good


def test_spans_like_brute_force():
    rng = random.Random(9)
    found = 0
    for _ in range(400):
        notice = [str(rng.randrange(6)) for _ in range(rng.randrange(3, 12))]
        words = []
        for _ in range(rng.randrange(1, 4)):
            cut = rng.randrange(len(notice))
            words += notice[cut:][: rng.randrange(1, 9)] + ["x"] * rng.randrange(3)
        scanner = licenses.LicenceScanner((), [("n", " ".join(notice))], least_match=2, chain_gap=2, coverage=0.6)
        held = {}
        whole = scanner._match

        def keep(begin, end, state, matches, whole=whole, held=held):
            whole(begin, end, state, matches)
            held.update(matches)

        scanner._match = keep
        spans = scanner.scan(words)[1]
        matches = held.get(0, [])
        if len(matches) > 9:
            continue
        assert set(matches) <= set(every_match(words, notice, 2))
        most, good = brute_spans(matches, len(notice), 2, 0.6)
        got = [(first, last + 1, round(share * len(notice))) for _, first, last, share in spans]
        assert sum(c for _, _, c in got) == most and set(got) <= set(good) and all(a[1] <= b[0] for a, b in itertools.pairwise(got))
        found += len(got)
    assert found > 100


def test_a_notice_with_its_first_words_repeated_within():
    words = dict(licenses.NOTICES)["bsd"].split()
    scanner = licenses.LicenceScanner(licenses.PHRASES, licenses.NOTICES)
    spans = scanner.scan([*words[:10], *words[:3], *words[10:]])[1]
    assert spans == [("bsd", 0, len(words) + 2, 1.0)]
    copies = scanner.scan(words * 300)[1]
    assert len(copies) == 300 and all(s[3] == 1.0 for s in copies)


def test_short_phrases_and_other_settings(spark):
    df = spark.createDataFrame([(1, "Free as in GPL, or gpl v3; MIT")], "doc_id long, text string")
    got = licenses.scan(df, phrases=(("gpl", "gpl"), ("gpl-3", "gpl v3"), ("mit", "mit"))).head()
    assert [(p["label"], p["first_word"]) for p in got["places"]] == [("gpl", 3), ("gpl", 5), ("gpl-3", 5), ("mit", 7)] and got["spans"] == []
    few = licenses.scan(df, phrases=(), notices=(("n", "free as in beer or gpl"),), least_match=1, coverage=0.8).head()["spans"]
    assert [(s["first_word"], s["last_word"], round(s["coverage"], 3)) for s in few] == [(0, 5, 0.833)]
