"""The turn loop over all sessions against a plain loop over one session after another."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import agent, evaluation
from ledgerlight.operators import conversation as C
from ledgerlight.streaming.agent import answer_stream

WORDS = {"red": ("red", "color"), "blue": ("blue", "color"), "green": ("green", "color"), "boots": ("boots", "category"), "hat": ("hat", "category"), "wool": ("wool", "material"), "soft wool": ("soft wool", "material"), "zip": ("zip", "style")}
ANSWERABILITY = {"color": 0.95, "material": 0.90, "size": 0.85, "style": 0.75, "brand": 0.65, "feature": 0.50}
WEIGHTS = {"metadata": 1.40, "exact_fts": 1.20, "expanded_fts": 0.80, "category_fallback": 0.25, "counterfactual": 0.15}
K = 4


@pytest.fixture(scope="module")
def shop():
    r = random.Random(3)
    items = []
    for i in range(70):
        attrs = {"color": [r.choice(["red", "blue", "green"])], "category": [r.choice(["boots", "hat"])], "material": r.sample(["wool", "soft wool", "felt"], r.randint(0, 2)), "brand": [f"b{r.randrange(4)}"]}
        if i % 3:
            attrs["style"] = ["zip" if i % 2 else "lace"]
        items.append((i, None if i % 11 == 0 else float(r.randint(5, 60)), r.randint(0, 9) / 10, " ".join(v for a in attrs.values() for v in a), attrs))
    return items


SAID = {
    "a": ["I'm looking for boots", "red, under $30", "actually, blue", "I don't have a preference"],
    "b": ["I need a hat, must be green", "no wool", "show me more", "soft wool only"],
    "c": ["must be under $1", "boots", "forget boots; hat", ""],
    "d": ["something warm", "must be red boots and only zip under $12", "next"],
    "e": ["", "not red, not blue, not green"],
    "f": [None, "I only want boots in soft wool with zip, must be blue, under $6", "at least $50"],
}


def tokens(text):
    return re.findall("[a-z0-9]+", text)


class Loop:
    def __init__(self, items, exploration):
        self.items, self.exploration = {i: x for i, *x in items}, exploration
        self.post = {i: {t: float(n) for n, t in enumerate(dict.fromkeys(tokens(x[2])), 1)} for i, x in self.items.items()}
        self.df = {}
        for p in self.post.values():
            for t, w in p.items():
                self.df[t] = self.df.get(t, 0) + 1

    def price(self, c, p):
        b = float(c["value"])
        return p is not None and (p <= b if c["operator"] == "less_than_or_equal" else p >= b if c["operator"] == "greater_than_or_equal" else p == b)

    def passes(self, i, filters):
        price, _, _, attrs = self.items[i]
        return all((self.price(c, price) if c["attribute"] == "budget" else c["value"] in attrs.get(c["attribute"], [])) != c["excluded"] for c in filters)

    def search(self, p):
        ok = [i for i in self.items if self.passes(i, p["filters"])]
        if p["route"] in ("exact_fts", "expanded_fts") or p["route"] == "counterfactual" and p["terms"]:
            score = {i: sum(self.post[i][t] * (math.log((len(self.items) + 1) / (self.df[t] + 1)) + 1) for t in p["terms"] if t in self.post[i]) for i in ok if any(t in self.post[i] for t in p["terms"])}
        else:
            want = [(t["attribute"], t["value"]) for t in p["targets"]]
            score = {i: self.items[i][1] for i in ok if not want or any(v in self.items[i][3].get(a, []) for a, v in want)}
        return [i for i, _ in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))]

    def values(self, i, a):
        return [self.items[i][2]] if a in ("other", "use_case") else self.items[i][3].get(a, [])

    def matches(self, i, c):
        if c["attribute"] == "budget":
            return self.price(c, self.items[i][0])
        return any(v in c["value"] or c["value"] in v for v in self.values(i, c["attribute"]) if v)

    def ranked(self, found, active, seen):
        rrf, strict, relaxed = {}, set(), {}
        for gone, route, hits in found:
            for n, i in enumerate(hits, 1):
                rrf[i] = rrf.get(i, 0) + WEIGHTS[route] / (60 + n)
                strict.add(i) if gone is None else relaxed.setdefault(i, gone)
        rows, belief = [], {}
        for i in rrf:
            hard = [c for c in active if c["strength"] == "hard"]
            gone = None
            if not (i in strict and all(self.matches(i, c) != c["excluded"] for c in hard)):
                gone = relaxed.get(i)
                if gone is None or not all(self.matches(i, c) != c["excluded"] for c in hard if c["id"] != gone):
                    continue
            soft = [c for c in active if c["strength"] == "soft"]
            rows.append((i, gone, rrf[i] + sum(0.01 * c["confidence"] for c in soft if self.matches(i, c) != c["excluded"])))
            if gone is None:
                x = 0.6 * rrf[i]
                for c in soft:
                    if not c["excluded"]:
                        unknown = self.items[i][0] is None if c["attribute"] == "budget" else not any(self.values(i, c["attribute"]))
                        x += c["confidence"] * math.log(0.4 if unknown else 0.8 if self.matches(i, c) else 0.12)
                belief[i] = x
        top = max(belief.values(), default=0)
        total = sum(math.exp(x - top) for x in belief.values())
        post = {i: math.exp(x - top) / total for i, x in belief.items()}
        order = sorted(rows, key=lambda r: (r[1] is not None, r[0] in seen, -round(post.get(r[0], 0), 12) if r[1] is None else 0, -round(r[2], 12), r[0]))
        return [(i, g) for i, g, _ in order], post

    def question(self, post, barred, turn):
        pool = sorted(post.items(), key=lambda x: (-x[1], x[0]))[:64]
        total, best = sum(p for _, p in pool), None
        h = lambda ps: -sum(p / sum(ps) * math.log2(p / sum(ps)) for p in ps if p > 0)
        for a in sorted(ANSWERABILITY):
            ps, vs = [p / total for _, p in pool], [(self.items[i][3].get(a) or [None])[0] for i, _ in pool]
            mass = {}
            for p, v in zip(ps, vs, strict=True):
                if v:
                    mass[v] = mass.get(v, 0) + p
            known = sum(mass.values())
            if a in barred or not known or turn >= 10:
                continue
            left = 0.15 * h(ps) + 0.85 * sum(m / known * h([p * (0.95 if v and (w in v or v in w) else 0.05) for p, v in zip(ps, vs, strict=True)]) for w, m in mass.items())
            gain = max(0, h(ps) - left)
            score = gain * ANSWERABILITY[a] * known - 0.05
            if gain > 0 and score >= 0.15 and (best is None or score > best[0] + 1e-12):
                best = (score, a)
        return best and best[1]

    def session(self, said):
        ledger, shown, shown_version, last, out = C.Ledger(), [], -1, None, []
        for turn, text in enumerate(said, 1):
            before, ups = ledger.version, C.extract(text, turn, last, WORDS, 2)
            ledger.apply(ups, turn)
            active = ledger.active()
            seen = shown if shown_version == ledger.version else []
            found = [(None, p["route"], self.search(p)) for p in agent.strict_plans(ledger)]
            order, post = self.ranked(found, active, seen)
            have = len(order[:K])
            asked = self.question(post, {*ledger.declined, *ledger.asked, *(c["attribute"] for c in active)}, turn)
            if have < K and (self.exploration or not have):
                for p in agent.relaxed_plans(ledger):
                    if len(order) >= K:
                        break
                    if not p["firm"] or have == 0:
                        found.append((p["relaxed"], p["route"], self.search(p)))
                        order, _ = self.ranked(found, active, seen)
            slate = order[:K]
            ids = [str(i) for i, g in slate if g is None], [str(i) for i, g in slate if g is not None]
            shown = [*seen, *(i for x in ids for i in [int(y) for y in x] if i not in seen)]
            shown_version, last = ledger.version, asked
            if asked:
                ledger.record_question(asked)
            out.append((turn, len(ups), before, ledger.version, [c["id"] for c in active], asked, *ids, list(dict.fromkeys(g for _, g in slate if g))))
        return out


@pytest.mark.parametrize("exploration", [False, True])
def test_turns_of_all_sessions_equal_a_plain_loop(spark, shop, tmp_path, exploration):
    loop = Loop(shop, exploration)
    items = spark.createDataFrame(shop, "id long, price double, quality_prior double, text string, attrs map<string,array<string>>")
    rows = items.select("id", F.explode("attrs").alias("attribute", "v")).select("id", "attribute", F.explode("v").alias("value"))
    postings = spark.createDataFrame([(i, t, w) for i, p in loop.post.items() for t, w in p.items()], "id long, term string, weighted_frequency double")
    every = agent.Catalog(items, rows, postings, postings.groupBy("term").agg(F.count("*").alias("document_frequency")), items.agg(F.count("*").alias("total")))
    turns = 4 if exploration else 2
    said = spark.createDataFrame([(s, t, x) for s, texts in SAID.items() for t, x in enumerate(texts, 1)], "session string, turn int, text string")
    words = spark.createDataFrame([(p, *v) for p, v in WORDS.items()], "phrase string, value string, attribute string")
    out, events = agent.traced_turns(said, words, every, k=K, turns=turns, exploration=exploration)
    answers = out.collect()
    got = {(r["session"], r["turn"]): (r["n_updates"], r["before_version"], r["version"], r["active_ids"], r["question"], r["strict_ids"], r["exploratory_ids"], sorted(r["relaxed_ids"])) for r in answers}
    want = {(s, x[0]): (*x[1:-1], sorted(x[-1])) for s, texts in SAID.items() for x in loop.session(texts[:turns])}
    assert got.keys() == want.keys()
    for key in sorted(want):
        assert got[key] == want[key], key
    assert any(w[6] for w in want.values()) and any(w[4] for w in want.values())
    events = events.collect()
    for (session, turn), w in want.items():
        own = {e["event_type"]: json.loads(e["body"]) for e in events if (e["session"], e["turn"]) == (session, turn)}
        assert own.keys() >= {"interpretation", "retrieval", "constraint", "belief", "question", "slate"}
        assert own["interpretation"]["active_constraint_ids"] == w[3] and own["question"]["selected_attribute"] == w[4]
        assert own["slate"]["strict_product_ids"] == w[5] and [str(c["id"]) for c in own["belief"]["candidates"]] == w[5]
        gate = own["constraint"]
        assert len(gate["rejected_product_ids"]) == min(50, gate["strict_candidate_count"] - gate["eligible_count"])
    if exploration:
        # the same messages as a stream, a session's turns now in one batch, now in several
        for n, turns in enumerate(([1], [2, 3], [4])):
            said.where(F.col("turn").isin(turns)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(said.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        answer_stream(stream, words, every, f"file://{tmp_path}/out", k=K, exploration=True).trigger(availableNow=True).start().awaitTermination(400)
        streamed = spark.read.option("basePath", f"{tmp_path}/out/answers").parquet(*[str(p) for p in (tmp_path / "out/answers").glob("batch=*/of=*")])
        assert {(r["session"], r["turn"]): (r["question"], r["strict_ids"], r["exploratory_ids"]) for r in streamed.collect()} == {k: v[4:7] for k, v in got.items()}
        told = spark.read.json([str(p) for p in (tmp_path / "out/trace").glob("batch=*/of=*")])
        assert sorted((r["session"], r["turn"], r["seq"], r["body"]) for r in told.collect()) == sorted((e["session"], e["turn"], e["seq"], e["body"]) for e in events)
    if not exploration:
        targets = spark.createDataFrame([("a", int(want["a", 2][5][1])), ("e", 10_000), ("zz", 1)], "session string, target long")
        told = spark.createDataFrame([(r["session"], r["turn"], r["strict_ids"], r["exploratory_ids"]) for r in answers], "session string, turn int, strict_ids array<string>, exploratory_ids array<string>")
        out = {r["sample_id"]: r for r in agent.evaluate_sessions(told, targets).collect()}
        assert out["a"]["hit"] and out["a"]["best_rank"] == (1 + want["a", 1][5].index(want["a", 2][5][1]) if out["a"]["first_hit_turn"] == 1 else 2)
        assert not out["e"]["hit"] and out["e"]["reciprocal_rank"] == 0.0 and not out["zz"]["hit"]
        assert evaluation.outcome_violations(agent.evaluate_sessions(told, targets)).count() == 0
