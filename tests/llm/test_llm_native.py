"""Line dedup and mixing against plain Python."""

import hashlib
from collections import Counter, defaultdict

from tempest.llm import linededup, mixing

WHITE = " \t\n\x0b\x0c\r"


def plain_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add((i, t))
    keep = {k: max(v, key=lambda x: -1 if x[0] is None else x[0])[0] for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_report_is_plain_line_dedup(odd_docs, odd_rows):
    got = Counter(tuple(r) for r in linededup.line_report(odd_docs).collect())
    assert got == plain_lines(odd_rows)
    assert sum(n for (_, _, dropped, _), n in got.items() if dropped) >= 2


def test_null_ids_are_smallest_and_copies_of_a_row_are_one_document(spark):
    line = "a line of more than twenty characters"
    rows = [(None, line), (None, line), (1, line), (1, line)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.n_dropped for r in linededup.line_report(d).collect()) == 0  # two documents only
    rows = [(None, line), (1, line + "\nx"), (1, line + "\ny"), (0, line)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_lines, r.n_dropped) for r in linededup.line_report(d).collect()}
    assert got == {(None, 1, 1), (0, 1, 1), (1, 2, 0)}


def test_bitmaps_and_applied_texts(odd_docs, clashing, odd_rows):
    maps = linededup.keep_bitmaps(odd_docs).collect()
    assert len(maps) >= len(odd_rows)
    for m in maps:
        assert m.n_dropped == sum(r.length for r in m.runs)
        ends = [(r.start, r.start + r.length) for r in m.runs]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))  # runs are maximal
    out = linededup.apply_bitmaps(clashing, linededup.dropped_runs(clashing))
    assert out.columns == clashing.columns
    assert {r.key for r in out.collect()} == {"mine-key"}
    texts = Counter(r.text for r in out.collect())
    assert texts[None] == 2
    want = Counter()
    for (_, _, _, sha), n in plain_lines(odd_rows).items():
        want[sha] += n
    assert Counter(hashlib.sha256((t or "").encode()).hexdigest() for t, n in texts.items() for _ in range(n)) == want


def test_lines_of_an_empty_table(no_docs):
    assert linededup.line_report(no_docs).count() == 0
    assert linededup.keep_bitmaps(no_docs).count() == 0
    assert linededup.apply_bitmaps(no_docs, linededup.dropped_runs(no_docs)).count() == 0


def plain_targets(sizes, weights=(1, 2, 3), times=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, total, target = set(names), sum(sizes.values()), {}
    while True:
        level = total / sum(w[s] for s in left) if left else 0
        over = {s for s in left if level * w[s] > times * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in left}
        for s in over:
            target[s] = float(times * sizes[s])
            total -= target[s]
        left -= over


def test_targets_and_taken_words(spark, odd_docs, odd_rows):
    import re

    sizes = defaultdict(int)
    for _, t, _, s, _ in odd_rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = odd_docs.select("*")
    got = mixing.pareto_mix(rows).collect()
    want = plain_targets(sizes)
    assert len(got) == len(odd_rows)
    by = defaultdict(list)
    for r in got:
        assert r.mix_source_size == sizes[r.source]
        assert abs(r.mix_target - want[r.source]) < 1e-6
        assert 0 <= r.mix_copies <= 3
        by[r.source].append(r)
    for s, rs in by.items():
        miss = abs(sum(r.mix_copies * r.mix_size for r in rs) - want[s])
        assert miss <= max(r.mix_size for r in rs), (s, miss)
        assert max(r.mix_copies for r in rs) - min(r.mix_copies for r in rs if r.mix_size) <= 1
    again = Counter(mixing.taken(odd_docs.repartition(7)).collect())
    assert again == Counter(mixing.taken(odd_docs).collect())


def test_sample_follows_the_order_of_odds(spark):
    rows = [(i, "w " * (1 + i % 7), "s" if i % 10 else "t") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.plan_source: r for r in mixing.mixing_plan(d).collect()}
    u = {r.doc_id: (r.source, r.size, r.u) for r in mixing.narrow_rows(d).collect()}
    taken = {r.doc_id: r.mix_copies for r in mixing.pareto_mix(d).collect()}
    assert any(p.p > 0 for p in plan.values())
    for s, p in plan.items():
        if not p.p:
            assert {taken[i] for i in taken if u[i][0] == s} == {p.whole}
            continue
        order = sorted((mixing.odds_ratio(x, p.p), size, i) for i, (src, size, x) in u.items() if src == s)
        words, rest, best = 0, p.target - p.whole * p.source_size, []
        for _, size, i in order:
            if abs(words + size - rest) >= abs(words - rest) and words + size > rest:
                break
            words += size
            best.append(i)
        assert {i for i in taken if u[i][0] == s and taken[i] > p.whole} == set(best)


def test_mix_of_clashing_and_empty_tables(clashing, no_docs):
    out = mixing.pareto_mix(clashing)
    assert out.columns == [c for c in clashing.columns if c != "mix_copies"] + list(mixing.ADDED)
    assert out.count() == clashing.count() and {r["size"] for r in out.collect()} == {"mine-size"}
    assert mixing.pareto_mix(no_docs).count() == 0 and mixing.taken(no_docs).count() == 0


def test_no_words_at_all(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.taken(d).collect()} == {(0.0, 0)}


def test_native_plans_have_no_python(odd_docs):
    for df in (linededup.key_positions(odd_docs), linededup.repeated_keys(linededup.key_positions(odd_docs)), mixing.narrow_rows(odd_docs),
               mixing.source_targets(mixing.narrow_rows(odd_docs)), mixing.taken(odd_docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
