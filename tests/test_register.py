"""The whole register on a small invented one, against plain Python."""

import csv
import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from holdfast.functions.text import whole_words
from holdfast.operators import checks as Q
from holdfast.operators.bands import Bands
from holdfast.plans.register import TABLES, Register, Rules, rows_with_comma
from holdfast.sources import polygons, sinks, tables

BANDS = Bands(((0.0, 30e6, "HF"), (30e6, 400e6, "VHF"), (400e6, 520e6, "UHF"), (520e6, 1e10, "mid"), (1e10, 1e12, "micro"), (1e12, None, "light")))
RULES = Rules(BANDS, class_rules=[(whole_words(["POLICE"]), "SAFETY"), (whole_words(["MINING"]), "MINING"), (whole_words(["SHIRE"]), "LOCAL")],
              classes=["SAFETY", "MINING", "LOCAL", "TELCO", "INDIVIDUAL", "UNCLASSIFIED"],
              not_personal=["PTY", "LIMITED", "POLICE", "MINING", "SHIRE", "BROADCAST"], issue_year=2026,
              placeholder_area=r"^zone \d", pseudo_region="Nowhere")

CLIENT = [  # CLIENT_NO, LICENCEE, ABN, ACN, CLIENT_TYPE_ID, CAT_ID
    ("1", "Big Tel Ltd", "20304050970", "001", "6", "T"), ("2", "BIG TEL LIMITED", "", "", "6", ""),
    ("3", "Tel Rural, Pty", "20304050970", "", "6", ""), ("4", "State Police", "", "", "3", "S"),
    ("5", "Deep Mining Pty Ltd", "20304050971", "", "6", ""), ("6", "Other Mining Pty Ltd", "20304050971", "", "6", ""),
    ("7", "Jane Citizen", "", "", "7", ""), ("8", "Ada & Boris Sample", "", "", "5", ""), ("9", "Shire of Nowhere", "", "", "4", ""),
    ("10", "Broadcast One Pty", "", "", "6", "B")]
LICENCE = []  # LICENCE_NO, CLIENT_NO, SV_ID, SS_ID, STATUS, STATUS_TEXT, DATE_ISSUED, DATE_OF_EXPIRY, BSL_NO
for i in range(60):
    client = str(i % 9 + 1) if i % 4 else "1"
    status = ("10", "Expired") if i % 11 == 5 else ("1", "Granted")
    sv = "85" if i % 15 == 4 else ("2" if i % 3 == 0 else "1")
    LICENCE.append((f"L{i}", client, sv, "x", *status, f"20{20 + i % 7}-03-01" if i % 6 else "", f"20{26 + i % 4}-05-05" if i % 5 else "", ""))
LICENCE += [("B1", "10", "90", "x", "1", "Granted", "2001-01-01", "", "bsl1"), ("B2", "10", "93", "x", "1", "Granted", "", "", "bsl2"),
            ("B3", "10", "1", "x", "1", "Granted", "", "", "bsl1"), ("P1", "8", "1", "x", "1", "Granted", "2026-01-01", "2027-01-01", "")]
DEVICE = []  # LICENCE_NO, SITE_ID, FREQUENCY, DEVICE_TYPE, SV_ID, CLASS, AUTH, DRI
for i in range(700):
    n = i * 7 % 61
    lic = LICENCE[n] if n < 60 else LICENCE[63]
    site = "" if i % 37 == 0 else ("home" if lic[0] == "P1" else f"s{(i * i + 3 * i) % 23}")
    hz = "" if i % 53 == 0 else ["27005000", "477437500", "11245000000.0", "10755000000", "195300000000000", "12500000"][(i * 5 + n) % 6]
    DEVICE += [(lic[0], site, hz, "TR"[i % 2] if hz else "", lic[2], ["ML", "FX", "ZZ", ""][i % 4], f"{1962 + i % 60}-01-02" if i % 9 else "", f"D{i}" if i % 3 else "")] * (3 if i % 10 == 0 else 1)
SITE = [(f"s{i}", f"{-30 - i / 7:.4f}", f"{140 + i / 3:.4f}", f"Tower {i}, Hill  Top", "Vic" if i == 3 else "VIC",
         ["Within 10 metres", "Within 100 metres", "Unknown"][i % 3]) for i in range(30)] + [("home", "-31", "141", "12 Smith St", "NSW", "")]
SPEC = [(f"L{i}", f"a{j}", "700000000", "715000000", "760000000" if j else "", "775000000" if j else "")
        for i in (4, 19, 34, 49) for j in range(3)] + [("L4", "a0", "800000000", "805000000", "", "")]
AREA = [(f"L{i}", f"a{j}", ["Sydney", "Zone 3", "Perth"][j]) for i in (4, 19, 34, 49) for j in range(3)]
DATA = {
    "client": CLIENT, "licence": LICENCE, "device_details": DEVICE, "site": SITE, "auth_spectrum_freq": SPEC, "auth_spectrum_area": AREA,
    "bsl": [("bsl1", "Radio", "Metro", "", "VIC", "One", "3AA", "1925-01-01"), ("bsl2", "TV", "", "General", "", "", "", "")],
    "applic_text_block": [("D1",), ("D1",), ("D2",), ("D5",), ("none",)], "licence_service": [("1", "Land"), ("2", "Fixed"), ("85", "Spectrum"), ("90", "Radio"), ("93", "TV"), ("7", "Unused")],
    "licence_subservice": [("x", "Any")], "client_type": [("7", "Person")], "class_of_station": [("ML", "Mobile"), ("FX", "Fixed")],
    "licence_status": [("1", "Granted"), ("10", "Expired")]}
BOX = {"features": [{"properties": {"sa4_code_2021": c, "sa4_name_2021": n, "state_name_2021": "VIC", "area_albers_sqkm": "100.6"}, "geometry": g}
                    for c, n, g in [("101", "West", {"type": "Polygon", "coordinates": [[[139, -40], [143, -40], [143, -20], [139, -20], [139, -40]]]}),
                                    ("197", "Nowhere at all", {"type": "Polygon", "coordinates": [[[139, -40], [146, -40], [146, -20], [139, -20], [139, -40]]]}),
                                    ("102", "East", {"type": "Polygon", "coordinates": [[[143, -40], [146, -40], [146, -20], [143, -20], [143, -40]]]})]]}


def as_csv(path, columns, data):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(columns)
        w.writerows(data)
    return str(path)


@pytest.fixture(scope="module")
def reg(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("register")
    made = build(spark, folder)
    for file in folder.iterdir():  # what is read once is not needed again
        file.unlink()
    return made


def build(spark, folder, **changed):
    data = {**DATA, **changed}
    read = {name: tables.read_table(spark, as_csv(folder / f"{name}.csv", cols, data[name]), cols) for name, cols in TABLES.items()}
    text = spark.createDataFrame([(json.dumps(BOX),)], "value string")
    people = spark.createDataFrame([("101", 1000.0), ("102", 0.0)], "code string, value double")
    listed = spark.createDataFrame([("BIG TEL LIMITED", "TELCO")], "key string, class string")
    return Register(spark, read, RULES, polygons.from_text(text), people, listed)


ROOT = {"1": "1", "2": "1", "3": "1"}
PERSON = {"7", "8"}
CLS = {"1": "TELCO", "4": "SAFETY", "5": "MINING", "6": "MINING", "7": "INDIVIDUAL", "8": "INDIVIDUAL", "9": "LOCAL", "10": "UNCLASSIFIED"}
HOLDER = {row[0]: ROOT.get(row[1], row[1]) for row in LICENCE}
GRANTED = {row[0] for row in LICENCE if row[4] == "1"}
SITES = {s[0] for s in SITE}


def band(hz):
    return next(i for i, (lo, hi, _) in enumerate(BANDS.rows) if float(hz) >= lo and (hi is None or float(hz) < hi))


def hz(d):
    return float(d[2])


def test_records_become_entities(reg):
    got = {r["root"]: (r["records"], r["person"], r["class"]) for r in reg.entities.collect()}
    assert got == {r: (3 if r == "1" else 1, r in PERSON, CLS[r]) for r in set(CLS)}


def test_entities_and_the_withheld_sum_to_the_register(reg):
    listed = reg.entity_result().collect()
    held = Counter(HOLDER.values())
    assert [r["licences"] for r in sorted(listed, key=lambda r: r["entity_id"])] == sorted((n for h, n in held.items() if h not in PERSON), reverse=True)
    devices = Counter(HOLDER[d[0]] for d in DEVICE)
    assert sum(r["devices"] for r in listed) == sum(n for h, n in devices.items() if h not in PERSON)
    own = reg.individuals().first()
    assert own["licences"] + sum(r["licences"] for r in listed) == len(LICENCE)
    assert own["entities"] == 2 and own["clients"] == 2 and own["devices"] == sum(devices[p] for p in PERSON)


def test_bands(reg):
    want = defaultdict(lambda: [0, 0, set(), set(), set()])
    for d in DEVICE:
        if d[2]:
            w = want[band(d[2])]
            w[0] += 1
            w[1] += d[3] == "T"
            w[2].add((d[0], d[1], hz(d), d[3]))
            w[3].add(d[0])
            w[4].add(HOLDER[d[0]])
    got = {r["band"]: (r["rows"], r["tx"], r["assignments"], r["licences"], r["holders"]) for r in reg.band_result().collect()}
    assert got == {b: (want[b][0], want[b][1], *(len(x) for x in want[b][2:])) if b in want else (0,) * 5 for b in range(len(BANDS.rows))}
    mix = Counter((band(d[2]), CLS[HOLDER[d[0]]]) for d in DEVICE if d[2])
    assert {(r["band"], r["class"]): r["rows"] for r in reg.makers()["band_classes"]().collect()} == dict(mix)


def test_exact_values_and_gaps(reg):
    want = Counter(hz(d) for d in DEVICE if d[2] and d[0] in GRANTED)
    assert {r["FREQUENCY"]: r["rows"] for r in reg.values().collect()} == dict(want)
    groups = defaultdict(lambda: ([], []))
    fixed = {row[0] for row in LICENCE if row[2] == "2"} & GRANTED
    for d in DEVICE:
        if d[0] in fixed and d[1] in SITES and d[2]:
            groups[d[0], d[1]][d[3] != "T"].append(hz(d))
    gaps, paired = Counter(), 0
    for t, r in groups.values():
        found = [int(abs(a - b) / 1e6 * 1000 + 0.5) / 1000 for a, b in zip(sorted(t), sorted(r)) if a != b]
        gaps.update(found)
        paired += bool(found)
    assert {r["gap"]: r["pairs"] for r in reg.makers()["gaps"]().collect()} == dict(gaps)
    assert {r["metric"]: r["n"] for r in reg.makers()["gap_totals"]().collect()} == {"groups": len(groups), "paired_groups": paired}


def site_facts():
    held = defaultdict(Counter)
    for d in DEVICE:
        if d[1] in SITES:
            held[d[1]][HOLDER[d[0]]] += 1
    ok = {s for s in held if any(d[1] == s and d[0] in GRANTED for d in DEVICE)}
    shown = {s for s in held if s in ok and not set(held[s]) <= PERSON}
    return held, shown


def test_sites_shown_and_withheld(reg):
    held, shown = site_facts()
    assert {r["SITE_ID"]: (r["devices"], r["holders"]) for r in reg.site_result().collect()} == {s: (sum(held[s].values()), len(held[s])) for s in shown}
    assert "home" in held and "home" not in shown
    assert not {r["name"] for r in reg.makers()["site_names"]().collect()} & {"12 Smith St"}


def test_tenancy(reg):
    held, shown = site_facts()
    pairs = Counter()
    for s in shown:
        cs = sorted({CLS[h] for h in held[s] if h not in PERSON})
        pairs.update((a, b) for i, a in enumerate(cs) for b in cs[i:])
    assert {(r["a"], r["b"]): r["sites"] for r in reg.tenancy_pairs().collect()} == dict(pairs)
    crowded = {s for s in shown if len(held[s]) >= 6}
    assert {r["SITE_ID"] for r in reg.tenancy_sites().collect()} == crowded and crowded
    named = Counter(r["SITE_ID"] for r in reg.tenancy_tenants().collect())
    assert named == {s: len(set(held[s]) - PERSON) for s in crowded}


def test_regions(reg):
    held, _ = site_facts()
    west = [s[0] for s in SITE if float(s[2]) < 143]
    got = {r["code"]: r for r in reg.region_result().collect()}
    assert set(got) == {"101", "102"}
    w = got["101"]
    assert (w["sites"], w["live"], w["area_km2"]) == (len(west), len([s for s in west if s in held]), 101.0)
    assert w["devices"] == sum(sum(held[s].values()) for s in west if s in held)
    assert w["per_ten_k"] == round(len(west) / 1000 * 1e4, 1) and got["102"]["per_ten_k"] is None
    assert w["holders"] == len(set().union(*(held[s] for s in west if s in held)))


def test_blocks(reg):
    got = {(r["market"], r["band"], r["entity_id"]): (r["width"], r["lower"], r["upper"], r["licences"]) for r in reg.block_result().collect()}
    assert {k[0] for k in got} == {"Sydney", "Perth"}
    total = sum(v[0] for v in got.values())
    assert total == sum((15 if a == "a0" else 30) if lo == "700000000" else 5 for l, a, lo, *_ in SPEC if a != "a1" and l in GRANTED)
    naive = reg.block_naive().collect()
    assert max(r["naive"] for r in naive) >= max(r["in_one_area"] for r in naive)


def test_health_and_history(reg):
    bars = {r["label"]: (r["n"], r["of"]) for r in reg.health().collect()}
    held, _ = site_facts()
    assert bars["sites with no device"] == (len(SITES) - len(held), len(SITES))
    assert bars["receiver rows"] == (sum(d[3] == "R" for d in DEVICE), len(DEVICE))
    assert bars["issued this year"][0] == sum(row[6].startswith("2026") for row in LICENCE)
    assert bars["clients without category"] == (sum(not c[5] for c in CLIENT), len(CLIENT))
    expiry = Counter(row[7][:4] or "never" for row in LICENCE if row[0] in GRANTED)
    assert {r["year"]: r["licences"] for r in reg.expiry().collect()} == dict(expiry)
    totals = reg.register_totals().first()
    assert (totals["rows"], totals["no_value"], totals["unmatched_rows"]) == (len(DEVICE), sum(not d[2] for d in DEVICE), 0)
    c = reg.conditions().first()
    assert (c["texts"], c["keys"], c["documented_matches"]) == (5, 4, 0) and c["device_matches"] == 3


def test_every_result_can_be_written(reg, tmp_path):
    made = reg.results()
    small = {k: made[k] for k in ("meta", "sector_totals", "sector_services", "sector_matrix", "entity_services", "entity_states", "bins",
                                  "bin_classes", "grid", "station_classes", "vintage", "gap_pairs", "region_classes", "band_top_holders", "tenancy_split")}
    sinks.write_results(small, str(tmp_path), "Based on an invented register")
    back = sinks.Results(reg.spark, str(tmp_path))
    assert {r["class"] for r in back.load("sector_totals").collect()} == set(RULES.classes)
    assert {r["SV_ID"]: r["licences"] for r in back.load("sector_services").collect()}["7"] == 0
    assert back.load("station_classes").filter("description is null").count() == 1
    assert back.load("vintage").count() == 60
    assert set(made) == set(reg.makers())


def test_gates_pass_and_pins_can_fail(reg):
    pins = [Q.equals("devices", "device_details", Q.rows(), len(DEVICE)), Q.equals("clients with a comma", "client", rows_with_comma(["LICENCEE"]), 1),
            Q.plausible("licences", "licence", Q.rows(), 1, 5)]
    report = reg.report(pins).persist()
    warnings = Q.enforce(report)
    assert sorted(w.split(":")[0] for w in warnings) == ["block areas have one block", "licences", "station classes are documented"]
    assert any(w.startswith("licences: 64.0") for w in warnings)
    assert report.count() == len(reg.checks()) + 3 and report.filter("kind = 'gate' and not ok").count() == 0
    report.unpersist()


def test_a_leak_is_caught(reg):
    made = reg.results()
    leaked = reg.site_records.filter("SITE_ID = 'home'").select("SITE_ID")
    made["sites"] = made["sites"].select("SITE_ID").union(leaked)
    made["site_names"] = made["site_names"].union(reg.spark.createDataFrame([("x", "  jane citizen ")], "SITE_ID string, name string"))
    with pytest.raises(Q.GateFailure) as e:
        Q.enforce(reg.report(results=made))
    assert "no person-only site is shown" in str(e.value) and "no person names a place" in str(e.value) and "recounted" not in str(e.value)


def failed(register, results=None):
    return {r["check_id"] for r in register.report(results=results).filter("kind = 'gate' and not ok").collect()}


def test_a_wrong_person_flag_is_caught(reg):
    wrong = Register.__new__(Register)
    wrong.__dict__.update({k: v for k, v in reg.__dict__.items() if k in ("spark", "rules", "t", "boundaries", "population", "dictionary", "clients",
                                                                          "entities", "ids", "licences", "site_records")})
    wrong.__dict__["tenants"] = reg.tenants.withColumn("person", F.lit(False))
    assert "home" in {r["SITE_ID"] for r in wrong.site_result().collect()}
    assert "no person-only site is shown" in failed(wrong)


def test_faulty_rows_fail_their_gates(spark, tmp_path):
    lost = DEVICE + [("no such licence", "s1", "27005000", "T", "1", "ML", "", "")]
    sites = SITE + [("", "-31", "141", "Nameless", "VIC", ""), ("s1", "-31", "141", "Again", "VIC", "")]
    old = [(*row[:6], "1066-10-14", *row[7:]) if row[0] == "L1" else row for row in LICENCE]
    register = build(spark, tmp_path, device_details=lost, site=sites, licence=old)
    assert register.site_records.count() == len(sites)
    assert failed(register) >= {"services sum to the file", "devices without a licence", "site keys are unique",
                                "dates are not older than the register"}


def test_the_register_as_a_whole(reg):
    held, shown = site_facts()
    sizes = {r["metric"]: r["value"] for r in reg.meta().collect()}
    assert sizes["licences"] == len(LICENCE) and sizes["granted"] == len(GRANTED) and sizes["clients"] == len(CLIENT)
    assert sizes["sites"] == len(SITE) and sizes["live_sites"] == len(held) and sizes["shown_sites"] == len(shown)
    made = reg.results()
    most = made["largest_holder"].first()
    licences = Counter(h for h in HOLDER.values() if h not in PERSON)
    assert most["licences"] == max(licences.values())
    assert made["region_extremes"].first()["most"] == "West"
    markets = {r["market"]: (r["width"], r["holders"]) for r in made["markets"].collect()}
    blocks = made["blocks"].collect()
    assert markets == {m: (sum(r["width"] for r in blocks if r["market"] == m), len({r["entity_id"] for r in blocks if r["market"] == m}))
                       for m in {r["market"] for r in blocks}}
    assert all(abs(r["share"] * r["column_width"] - r["width"]) < 1e-9 for r in made["market_shares"].collect())
    assert made["lorenz"].agg(F.max("cum_size")).first()[0] == sum(licences.values())
    split = {r["medium"]: (r["dated"], r["undated"], r["first_year"]) for r in made["dated_split"].collect()}
    assert split == {"Radio": (1, 0, 1925), "TV": (0, 1, None)}
    assert [(r["interest"], r["services"]) for r in made["interests"].collect()] == [("General", 1)]
    assert made["tenancy_totals"].count() and made["share_slope"].count() and made["region_densities"].count() == 2
    assert reg.entity(0).count() == 1 and reg.entity(-1).count() == 0 and reg.entity(10_000).count() == 0


def test_checks_by_themselves(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "a int, b double")
    report = {r["check_id"]: r["ok"] for r in Q.run_checks({"t": df, "none": df.limit(0)}, [
        Q.equals("rows", "t", Q.rows(), 2), Q.equals("null counts as violation", "t", Q.violations(F.col("b") > 0), 1),
        Q.in_range("share", "t", Q.share_of(F.col("a") > 1), 0.5, 0.5), Q.in_range("no value fails", "none", F.max("b"), lo=0),
        Q.plausible("warn", "t", F.max("a"), 5, 9)]).collect()}
    assert report == {"rows": True, "null counts as violation": True, "share": True, "no value fails": False, "warn": False}
    gone = Q.histogram_difference(df.groupBy("a").count(), {"1": 1, "2": 1}, "a", "count")
    assert gone.count() == 0


def test_counting_on_the_drawing_is_caught(reg):
    from dataclasses import replace
    from holdfast.operators import geo as G
    drawn = Register.__new__(Register)
    drawn.__dict__.update({k: v for k, v in reg.__dict__.items() if k in ("spark", "t", "boundaries", "site_records")})
    drawn.__dict__["rules"] = replace(RULES, drawing_grid=30.0)
    assert "places are not those of the drawing" in {c.id for c in drawn.checks()} - {c.id for c in reg.checks()}
    assert drawn.coarse_places().count() > 0
    coarse = G.coarsened(polygons.parts(reg.regions), 30.0)
    moved = G.locate(reg.site_records, coarse, id="SITE_ID", lat="lat", lon="lon")
    drawn.__dict__["site_records"] = reg.site_records.drop("region").join(moved, "SITE_ID")
    assert drawn.coarse_places().isEmpty()
