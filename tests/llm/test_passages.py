import random

import brute
from prepflow.llm import exchange, line_dedup


def _without(rows, lines=3, words=50):
    """{doc_id: (n_removed, kept text)}: later copies of runs of ``lines`` lines, or of ``words`` words in fewer."""
    docs, first = [], {}
    for i, t in sorted(rows):
        all_lines = t.encode().split(b"\n")
        docs.append((i, all_lines, [k for k, x in enumerate(all_lines) if x.strip(brute.BLANK)]))

    def runs(all_lines, at):
        for size in range(1, lines + 1):
            for k in range(len(at) - size + 1):
                run = tuple(all_lines[j].strip(brute.BLANK) for j in at[k : k + size])
                if size == lines or sum(len(x.split()) for x in run) >= words:
                    yield k, size, run

    for i, all_lines, at in docs:
        for k, _, run in runs(all_lines, at):
            first.setdefault(run, (i, k))
    out = {}
    for i, all_lines, at in docs:
        gone = {j for k, size, run in runs(all_lines, at) if first[run] != (i, k) for j in at[k : k + size]}
        out[i] = (len(gone), b"\n".join(x for j, x in enumerate(all_lines) if j not in gone).decode())
    return out


def _found(df, **more):
    return {r["doc_id"]: (r["n_removed"], r["kept"]) for r in line_dedup.remove_repeated_lines(df, **more).collect()}


def test_passages_of_one_and_two_lines(clash):
    one, half, rest = " ".join(f"w{i}" for i in range(50)), " ".join(["a b"] * 15), " ".join(["c d"] * 10)
    short = " ".join(f"w{i}" for i in range(49))
    rows = [(1, one), (2, one), (3, f"own\n{one}\nmine"), (4, f"{half}\n\n{rest}"), (5, f"{half} \n{rest}"), (6, half), (7, short), (8, short)]
    found = _found(clash(rows))
    assert found == _without(rows)
    assert found[1] == (0, one) and found[2] == (1, "") and found[3] == (1, "own\nmine") and found[5] == (2, "")
    assert found[6] == (0, half) and found[8] == (0, short)  # fewer than 50 words


def test_passages_against_brute_force(clash, monkeypatch):
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 2_000)
    rng = random.Random(5)
    lines = [" ".join(rng.choices("p q r s é".split(), k=rng.choice([1, 20, 30, 49, 50, 80]))) for _ in range(14)] + ["", " \t"]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 5)))) for i in range(120)]
    assert _found(clash(rows)) == _without(rows)
