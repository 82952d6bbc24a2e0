"""Batch forms of one-at-a-time rules against a sequential simulation on
random small fixtures (hot keys, repeats, prior redemptions, NULL caps)."""

import datetime as dt
import random

import pytest

from helpers_business import mk
from ledgerlark.operators import accounts as ac, coupons as cp


def simulate_coupons(coupons, redemptions, attempts):
    by_code = {}
    for c in sorted(coupons, key=lambda c: c["id"]):
        by_code.setdefault(c["code"], c)
    uses = {c["id"]: 0 for c in coupons}
    used_by = {c["id"]: set() for c in coupons}
    for r in redemptions:
        uses[r["coupon_id"]] += 1
        used_by[r["coupon_id"]].add(r["business_id"])
    out = {}
    for a in sorted(attempts, key=lambda a: (a["attempted_at"], a["business_id"], a["attempt_id"])):
        c = by_code.get(a["code"].upper())
        if c is None:
            out[a["attempt_id"]] = "not_found"
            continue
        if c["max_uses"] is not None and uses[c["id"]] >= c["max_uses"]:
            out[a["attempt_id"]] = "max_uses"
        elif a["business_id"] in used_by[c["id"]]:
            out[a["attempt_id"]] = "already_used"
        else:
            out[a["attempt_id"]] = "ok"
            if c["type"] == "trial":
                uses[c["id"]] += 1
                used_by[c["id"]].add(a["business_id"])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_coupon_decisions_match_simulation(spark, seed):
    rnd = random.Random(seed)
    coupons = [{"id": i, "code": f"K{i}", "type": rnd.choice(["trial", "discount"]),
                "value": 5, "max_uses": rnd.choice([None, 1, 2, 3, 5, 8])} for i in range(6)]
    redemptions = [{"coupon_id": rnd.randrange(6), "business_id": rnd.randrange(10)} for _ in range(8)]
    t0 = dt.datetime(2020, 1, 1)
    attempts = []
    for i in range(300):
        hot = rnd.random() < 0.4                      # coupon 0 takes ~40 % of attempts
        code = "K0" if hot else rnd.choice([f"K{j}" for j in range(6)] + ["NOPE"])
        attempts.append({"attempt_id": f"{i:04d}", "code": code.lower() if rnd.random() < 0.3 else code,
                         "business_id": rnd.randrange(12),
                         "attempted_at": t0 + dt.timedelta(hours=rnd.randrange(60))})
    want = simulate_coupons(coupons, redemptions, attempts)
    d = cp.coupon_decisions(mk(spark, "coupon_attempts", attempts), mk(spark, "coupons", coupons),
                            mk(spark, "coupon_redemptions", redemptions))
    got = {r["attempt_id"]: r["reason"] for r in d.collect()}
    assert got == want


@pytest.mark.parametrize("seed", [4, 5])
def test_review_quota_matches_simulation(spark, seed):
    rnd = random.Random(seed)
    biz = [{"id": i, "trial_reviews_remaining": rnd.choice([None, 0, 1, 3, 10])} for i in range(8)]
    subs = [{"id": i, "business_id": i, "status": rnd.choice(["active", "cancelling", "cancelled"])}
            for i in range(0, 8, 3)]
    t0 = dt.datetime(2020, 1, 1)
    attempts = [{"attempt_id": i, "business_id": 0 if rnd.random() < 0.4 else rnd.randrange(9),
                 "attempted_at": t0 + dt.timedelta(minutes=rnd.randrange(500))} for i in range(200)]
    quota = {b["id"]: b["trial_reviews_remaining"] for b in biz}
    status = {s["business_id"]: s["status"] for s in subs}
    want, left = {}, dict(quota)
    for a in sorted(attempts, key=lambda a: (a["attempted_at"], a["attempt_id"])):
        b = a["business_id"]
        if b not in quota:
            want[a["attempt_id"]] = "unknown"
        elif status.get(b) in ("active", "cancelling"):
            want[a["attempt_id"]] = "subscribed"
        elif (left[b] or 0) <= 0:
            want[a["attempt_id"]] = "limit_reached"
        else:
            left[b] -= 1
            want[a["attempt_id"]] = "trial"
    d, bal = ac.review_quota(mk(spark, "businesses", biz), mk(spark, "subscriptions", subs),
                             mk(spark, "review_attempts", attempts))
    assert {r["attempt_id"]: r["reason"] for r in d.collect()} == want
    for r in bal.collect():
        assert r["new_quota"] == left[r["business_id"]]
