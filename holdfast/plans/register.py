"""The whole register: from its tables to every published result, and the gates over them.

Each grain that several results read (records, licences, holders per band, tenants per site) is
made once and kept as a table in the checkpoint folder; the results are queries over those.
Results are tables with named columns; long form is used where a document would nest.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.dates import year_token
from holdfast.functions.identifiers import valid_abn
from holdfast.functions.numbers import half_up, log_bin, ratio, ratio_floor_one, width
from holdfast.functions.text import any_contains, clean_spaces, name_key, ordered_code
from holdfast.operators import bands as B
from holdfast.operators import blocks as K
from holdfast.operators import checks as Q
from holdfast.operators import concentration as C
from holdfast.operators import entity as E
from holdfast.operators import geo as G
from holdfast.operators import joins as J
from holdfast.operators import pairing as P
from holdfast.operators import rollups as R
from holdfast.operators import tenancy as N
from holdfast.operators.ordering import best
from holdfast.scale import durable, skew_join
from holdfast.sources import polygons
from holdfast.sources.tables import typed

# The columns used of every register table, and their types. Not listed: string.
TABLES: dict[str, list[str]] = {
    "device_details": ["LICENCE_NO", "SITE_ID", "FREQUENCY", "DEVICE_TYPE", "SV_ID", "CLASS_OF_STATION_CODE",
                       "AUTHORISATION_DATE", "DEVICE_REGISTRATION_IDENTIFIER"],
    "licence": ["LICENCE_NO", "CLIENT_NO", "SV_ID", "SS_ID", "STATUS", "STATUS_TEXT", "DATE_ISSUED",
                "DATE_OF_EXPIRY", "BSL_NO"],
    "client": ["CLIENT_NO", "LICENCEE", "ABN", "ACN", "CLIENT_TYPE_ID", "CAT_ID"],
    "site": ["SITE_ID", "LATITUDE", "LONGITUDE", "NAME", "STATE", "SITE_PRECISION"],
    "auth_spectrum_freq": ["LICENCE_NO", "AREA_CODE", "LW_FREQUENCY_START", "LW_FREQUENCY_END",
                           "UP_FREQUENCY_START", "UP_FREQUENCY_END"],
    "auth_spectrum_area": ["LICENCE_NO", "AREA_CODE", "AREA_NAME"],
    "bsl": ["BSL_NO", "MEDIUM_CATEGORY", "REGION_CATEGORY", "COMMUNITY_INTEREST", "BSL_STATE", "ON_AIR_ID",
            "CALL_SIGN", "DATE_COMMENCED"],
    "applic_text_block": ["LICENCE_NO"],
    "licence_service": ["SV_ID", "SV_NAME"],
    "licence_subservice": ["SS_ID", "SS_NAME"],
    "client_type": ["TYPE_ID", "NAME"],
    "class_of_station": ["CODE", "DESCRIPTION"],
    "licence_status": ["STATUS", "STATUS_TEXT"],
}
TYPES = {
    "FREQUENCY": "double", "LATITUDE": "double", "LONGITUDE": "double", "AUTHORISATION_DATE": "date",
    "DATE_ISSUED": "date", "DATE_OF_EXPIRY": "date", "DATE_COMMENCED": "date",
    "LW_FREQUENCY_START": "double", "LW_FREQUENCY_END": "double",
    "UP_FREQUENCY_START": "double", "UP_FREQUENCY_END": "double",
}


@dataclass(frozen=True)
class Rules:
    """What the caller decides: bands, classes, words. The codes are the register's own."""

    bands: B.Bands
    class_rules: Sequence[tuple[str, str]] = ()
    classes: Sequence[str] = ()
    not_personal: Sequence[str] = ()
    # Patterns of area labels that are placeholders, and of regions that are no places; None: there are none.
    placeholder_area: str | None = None
    pseudo_region: str | None = None
    # Codes of the register.
    granted: str = "1"
    person_type: str = "7"
    person_class: str = "INDIVIDUAL"
    default_class: str = "UNCLASSIFIED"
    fixed_service: str = "2"
    spectrum_service: str = "85"
    broadcast_services: Sequence[str] = ("90", "93")
    accuracy: Sequence[str] = ("Within 10 metres", "Within 100 metres")
    issue_year: int | None = None
    # Regions with fewer people than this are not compared by rates.
    population_floor: float = 0.0
    # No date of the register is older than this year.
    first_year: int = 1900
    beyond: float = 1e12
    # Share of sites that lie in a region, and the grid in degrees of the boundaries that are drawn; None: nothing is drawn.
    match_rate: tuple[float, float] = (0.0, 1.0)
    drawing_grid: float | None = None


class Register:
    """Tables (as read, text columns), boundaries, population and dictionary in; results out."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], rules: Rules,
                 boundaries: DataFrame | None = None, population: DataFrame | None = None,
                 dictionary: DataFrame | None = None):
        self.spark, self.rules = spark, rules
        # Read once: a table with line breaks in its fields is one task a file, so what many results and
        # gates read is the typed copy, which is columnar and can be split.
        self.t = {name: durable(typed(tables[name].select(*columns), TYPES)) for name, columns in TABLES.items()}
        self.boundaries = boundaries
        self.population = population
        self.dictionary = dictionary if dictionary is not None else spark.createDataFrame([], "key string, class string")

    # --- grains ------------------------------------------------------------------------------

    @cached_property
    def clients(self) -> DataFrame:
        """Licensee records with key, licences, person flag and the root of their entity."""
        per = R.histogram(self.t["licence"], "CLIENT_NO", name="licences")
        named = self.t["client"].withColumn("key", name_key(F.col("LICENCEE")))
        counted = named.join(per, "CLIENT_NO", "left").fillna(0, ["licences"])
        flag = E.person_flag(F.col("CLIENT_TYPE_ID") == self.rules.person_type, F.col("ACN").isNotNull(),
                             F.col("licences"), F.col("key"), self.rules.not_personal)
        records = durable(counted.withColumn("person", flag))
        keys = [F.when(F.col("key") != "", F.col("key")), F.when(valid_abn(F.col("ABN")), F.col("ABN"))]
        return durable(records.join(E.components(records, "CLIENT_NO", keys), "CLIENT_NO"))

    @cached_property
    def entities(self) -> DataFrame:
        """One row per entity, classified, before the facts are added."""
        ents = E.entities(self.clients, id="CLIENT_NO", root="root", name="LICENCEE", type="CLIENT_TYPE_ID",
                          person="person", licences="licences").withColumn("key", name_key(F.col("name")))
        classed = E.classify(ents, "key", "person", self.dictionary, self.rules.class_rules,
                             person_class=self.rules.person_class, default=self.rules.default_class)
        return durable(classed.drop("key"))

    @cached_property
    def ids(self) -> DataFrame:
        return durable(E.dense_ids(self.entities, "licences", "root", "person"))

    @cached_property
    def licences(self) -> DataFrame:
        """Licences with entity, class, person flag (of the entity) and status."""
        owner = self.clients.select("CLIENT_NO", "root").join(
            self.entities.select("root", "class", "person"), "root")
        return durable(skew_join(self.t["licence"], owner, "CLIENT_NO").withColumn(
            "granted", F.coalesce(F.col("STATUS") == self.rules.granted, F.lit(False))))

    @cached_property
    def devices(self) -> DataFrame:
        return self.t["device_details"].withColumn("tx", F.coalesce(F.col("DEVICE_TYPE") == "T", F.lit(False)))

    @cached_property
    def holder_bands(self) -> DataFrame:
        devices = self.rules.bands.assign(self.devices, "FREQUENCY")
        return durable(B.holder_bands(
            devices, self.licences, band="band", licence="LICENCE_NO", holder=["root", "class", "person"],
            key=["LICENCE_NO", "SITE_ID", "FREQUENCY", "DEVICE_TYPE"], transmit="tx"))

    @cached_property
    def holder_bins(self) -> DataFrame:
        devices = self.devices.withColumn("bin", log_bin(F.col("FREQUENCY"))).filter("bin >= 0")
        return durable(B.holder_bands(devices, self.licences, band="bin", licence="LICENCE_NO",
                                      holder=["root", "class", "person"], key=[], transmit="tx"))

    @cached_property
    def site_records(self) -> DataFrame:
        """Site records, cleaned, with the region each lies in (-1: none). No record is lost, ids or not."""
        s = self.t["site"]
        clean = s.select(
            "SITE_ID", F.col("LATITUDE").alias("lat"), F.col("LONGITUDE").alias("lon"),
            clean_spaces(F.col("NAME")).alias("name"), F.upper("STATE").alias("state"),
            ordered_code(F.coalesce("SITE_PRECISION", F.lit("")), self.rules.accuracy).alias("accuracy"))
        if self.boundaries is None:
            return durable(clean.withColumn("region", F.lit(-1)))
        found = G.locate(clean, polygons.parts(self.regions), id="SITE_ID", lat="lat", lon="lon")
        return durable(clean.join(found, "SITE_ID", "left").fillna(-1, ["region"]))

    @cached_property
    def regions(self) -> DataFrame:
        """Boundary features without the pseudo-regions, numbered as in the file."""
        named = self.boundaries.withColumn("_name", F.col("properties")["sa4_name_2021"])
        return G.drop_named(named, "_name", self.rules.pseudo_region).drop("_name")

    @cached_property
    def tenants(self) -> DataFrame:
        """(site, holder), over device rows whose site is on record."""
        rolled = R.site_holders(self.devices, self.licences, site="SITE_ID", licence="LICENCE_NO", holder="root",
                                cls="class", person="person", granted="granted", transmit="tx")
        return durable(skew_join(rolled, self.t["site"].select("SITE_ID"), "SITE_ID", "left_semi", probe=self.devices))

    @cached_property
    def live_sites(self) -> DataFrame:
        return durable(R.site_rollup(self.tenants, "SITE_ID"))

    @cached_property
    def publishable(self) -> DataFrame:
        """The site layer that may be shown: never a site whose every device is a person's."""
        kept = self.live_sites.filter("publishable").join(self.site_records, "SITE_ID")
        return durable(kept.join(R.modal_class(self.tenants, "SITE_ID"), "SITE_ID"))

    @cached_property
    def totals(self) -> DataFrame:
        """Entities with licences, devices, transmit rows and sites."""
        per = R.licence_rows(self.devices, "LICENCE_NO", "tx").join(
            self.licences.select("LICENCE_NO", "root"), "LICENCE_NO")
        return durable(R.entity_totals(self.entities, per, self.tenants, key="root", holder="root", site="SITE_ID"))

    @cached_property
    def pairs(self) -> DataFrame:
        return durable(P.gaps(P.ordinal_pairs(self.fixed_links, ["LICENCE_NO", "SITE_ID"], "FREQUENCY", F.col("tx"))))

    @cached_property
    def fixed_links(self) -> DataFrame:
        """Device rows of granted fixed links at a site on record, with a value."""
        fixed = self.licences.filter(F.col("granted") & (F.col("SV_ID") == self.rules.fixed_service)).select("LICENCE_NO")
        rows = self.devices.filter(F.col("FREQUENCY").isNotNull() & F.col("SITE_ID").isNotNull()) \
            .select("LICENCE_NO", "SITE_ID", "FREQUENCY", "tx")
        granted = skew_join(rows, fixed, "LICENCE_NO", "left_semi")
        return durable(skew_join(granted, self.t["site"].select("SITE_ID"), "SITE_ID", "left_semi", probe=rows))

    @cached_property
    def blocks(self) -> DataFrame:
        """Blocks of granted licences with entity, band and widths."""
        f = {c: F.col(c) for c in TABLES["auth_spectrum_freq"]}
        rows = self.rules.bands
        granted = self.licences.filter("granted").select("LICENCE_NO", "root")
        return durable(self.t["auth_spectrum_freq"].join(granted, "LICENCE_NO").select(
            "LICENCE_NO", "AREA_CODE", "root", F.coalesce(rows.index(f["LW_FREQUENCY_START"]), F.lit(-1)).alias("band"),
            width(f["LW_FREQUENCY_START"], f["LW_FREQUENCY_END"]).alias("lower"),
            F.coalesce(width(f["UP_FREQUENCY_START"], f["UP_FREQUENCY_END"]), F.lit(0.0)).alias("upper")))

    # --- results ----------------------------------------------------------------------------------

    def published(self, df: DataFrame, key: str = "root") -> DataFrame:
        """Replace the entity key by its published id, -1 when withheld."""
        numbered = self.ids.select(F.col("root").alias(key), "entity_id")
        return df.join(numbered, key, "left").withColumn("entity_id", F.coalesce("entity_id", F.lit(-1))).drop(key)

    def results(self) -> dict[str, DataFrame]:
        """Every result by name. Nothing is computed for a result that is not used, but its grains."""
        return {name: make() for name, make in self.makers().items()}

    def makers(self) -> dict[str, Callable[[], DataFrame]]:
        return {
            "meta": self.meta, "largest_holder": self.largest_holder, "entities": self.entity_result, "entity_services": self.entity_services,
            "entity_states": self.entity_states, "individuals": self.individuals,
            "sector_totals": self.sector_totals, "sector_services": self.sector_services,
            "sector_matrix": self.sector_matrix,
            "bands": self.band_result, "band_classes": lambda: B.class_mix(self.holder_bands, "band", "class"),
            "band_top_holders": self.band_top_holders,
            "bins": self.bin_result, "bin_classes": lambda: B.class_mix(self.holder_bins, "bin", "class"),
            "values": self.values, "gaps": lambda: P.gap_histogram(self.pairs),
            "gap_pairs": lambda: P.top_pairs(self.pairs, 900),
            "gap_totals": lambda: P.pairing_totals(self.fixed_links, self.pairs, ["LICENCE_NO", "SITE_ID"]),
            "regions": self.region_result, "region_classes": self.region_classes,
            "sites": self.site_result, "site_names": lambda: self.publishable.select("SITE_ID", "name"),
            "grid": lambda: G.density_grid(self.publishable, "lat", "lon", F.col("devices")),
            "tenancy_pairs": self.tenancy_pairs, "tenancy_sites": self.tenancy_sites,
            "tenancy_tenants": self.tenancy_tenants, "tenancy_split": lambda: N.sharing_split(self.publishable),
            "tenancy_totals": lambda: N.pair_totals(self.tenancy_pairs()),
            "blocks": self.block_result, "block_naive": self.block_naive,
            "markets": lambda: K.market_summary(self.block_result(), "market", "entity_id"),
            "market_shares": lambda: K.market_shares(self.block_result(), "market", "band"),
            "lorenz": self.lorenz, "gini": lambda: C.gini(self.lorenz()), "share_slope": self.share_slope,
            "dated_split": self.dated_split, "interests": self.interests,
            **({} if self.boundaries is None else {"region_extremes": self.region_extremes, "region_densities": self.region_densities}),
            "broadcast_services": lambda: self.t["bsl"], "health": self.health, "conditions": self.conditions,
            "expiry": self.expiry, "issued": lambda: R.year_histogram(
                self.licences, F.col("DATE_ISSUED"), "blank", "licences"),
            "vintage": self.vintage, "register_totals": self.register_totals,
            "services": lambda: self.t["licence_service"], "subservices": lambda: self.t["licence_subservice"],
            "client_types": lambda: self.t["client_type"], "station_classes": self.station_classes,
        }

    def meta(self) -> DataFrame:
        """Headline figures as (metric, value): concentration, then the size of the register."""
        count = F.count(F.lit(1))
        sizes = Q.reconcile(
            licences=self.licences.agg(count), granted=self.licences.agg(F.count_if("granted")), clients=self.t["client"].agg(count),
            entities=self.entities.agg(count), sites=self.t["site"].agg(count), live_sites=self.live_sites.agg(count),
            shown_sites=self.publishable.agg(count))
        long = sizes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in sizes.columns])).alias("m"))
        return C.headline(self.entities.filter("licences > 0"), "licences", "person").unionByName(long.select("m.metric", "m.value"))

    def region_extremes(self) -> DataFrame:
        """The region with most sites a head, and that with fewest above the floor of population: one row."""
        rated = self.region_result().withColumn("rate", F.coalesce("per_ten_k", F.lit(0.0)))
        low = F.when(F.col("population") > self.rules.population_floor, F.struct(F.col("rate").alias("s"), F.col("region").alias("t")))
        return rated.agg(best("name", "rate", "region").alias("most"), F.max("rate").alias("most_rate"),
                         F.min_by("name", low).alias("least"), F.min(F.when(low.isNotNull(), F.col("rate"))).alias("least_rate"))

    def region_densities(self) -> DataFrame:
        """Live sites per 1,000 km², and the largest holder's share of the live sites."""
        return self.region_result().select(
            "region", (ratio_floor_one(F.col("live"), F.col("area_km2")) * 1000).alias("per_thousand"),
            ratio(F.col("top_holder_sites"), F.col("live")).alias("concentration"))

    def lorenz(self) -> DataFrame:
        return C.lorenz(self.entities.filter(~F.col("person") & (F.col("licences") > 0)), "licences")

    def share_slope(self) -> DataFrame:
        """Share of licences against share of devices, classes above a hundredth on either."""
        return R.shares(self.totals, "class", {"licences": "licences", "devices": "devices"}, 1.0)

    def dated_split(self) -> DataFrame:
        """Broadcast services dated and undated by medium, and the ends of the axis."""
        day = F.col("DATE_COMMENCED")
        return self.t["bsl"].groupBy(F.col("MEDIUM_CATEGORY").alias("medium")).agg(
            F.count(day).alias("dated"), F.count_if(day.isNull()).alias("undated"),
            F.year(F.min(day)).alias("first_year"), F.year(F.max(day)).alias("last_year"))

    def interests(self) -> DataFrame:
        named = self.t["bsl"].filter(F.col("COMMUNITY_INTEREST").isNotNull() & (F.col("COMMUNITY_INTEREST") != ""))
        return R.histogram(named, F.col("COMMUNITY_INTEREST").alias("interest"), name="services")

    def entity(self, entity_id: int) -> DataFrame:
        """One published entity by its id; no row for -1 and ids that name none."""
        return self.entity_result().filter(F.col("entity_id") == int(entity_id))

    def largest_holder(self) -> DataFrame:
        return C.largest_holder(self.entities, "licences", "name", "root", "person")

    def entity_result(self) -> DataFrame:
        return self.published(self.totals.filter(~F.col("person"))).select(
            "entity_id", "name", "class", "licences", "devices", "tx", "sites", "records")

    def entity_services(self) -> DataFrame:
        held = self.licences.filter(~F.col("person")).select("root", "SV_ID").distinct()
        return self.published(held)

    def entity_states(self) -> DataFrame:
        states = self.site_records.filter(F.col("state").isNotNull()).select("SITE_ID", "state")
        at = self.tenants.filter(~F.col("person")).select("SITE_ID", F.col("holder").alias("root")).join(states, "SITE_ID")
        return self.published(at.select("root", "state").distinct())

    def individuals(self) -> DataFrame:
        sums = {"licences": "licences", "devices": "devices", "sites": "sites"}
        withheld = E.withheld_totals(self.totals, "person", sums)
        own = self.clients.filter("person").agg(
            F.count(F.lit(1)).alias("clients"), F.coalesce(F.sum("licences"), F.lit(0)).alias("client_level_licences"))
        both = withheld.unionByName(own, allowMissingColumns=True)
        return both.agg(*[F.max(c).alias(c) for c in both.columns])

    def class_domain(self) -> DataFrame:
        listed = [(c,) for c in self.rules.classes]
        used = self.entities.select("class").distinct()
        return used if not listed else used.union(self.spark.createDataFrame(listed, "class string")).distinct()

    def sector_totals(self) -> DataFrame:
        return R.class_totals(self.totals, "class", ["licences", "devices", "tx", "sites"], self.class_domain())

    def sector_services(self) -> DataFrame:
        counted = R.histogram(self.licences, "SV_ID", name="licences")
        return J.dense(counted, self.t["licence_service"], ["SV_ID"], ["licences"])

    def sector_matrix(self) -> DataFrame:
        return self.licences.groupBy("class", "SV_ID").agg(F.count(F.lit(1)).alias("licences"))

    def band_result(self) -> DataFrame:
        rolled = B.band_rollup(self.holder_bands, "band")
        return J.dense(rolled, self.rules.bands.frame(self.spark), ["band"],
                       ["rows", "tx", "assignments", "licences", "holders"])

    def band_top_holders(self) -> DataFrame:
        from holdfast.operators.ordering import top_per_group
        named = self.holder_bands.filter(~F.col("person")).select("band", "root", "rows")
        return self.published(top_per_group(named, ["band"], [F.desc("rows"), F.asc("root")], 12))

    def bin_result(self) -> DataFrame:
        return B.band_rollup(self.holder_bins, "bin").select("bin", "rows", "tx", "holders")

    def values(self) -> DataFrame:
        return B.value_rollup(self.devices, self.licences.filter("granted"), value="FREQUENCY",
                              licence="LICENCE_NO", transmit="tx")

    def region_table(self) -> DataFrame:
        p = F.col("properties")
        listed = self.regions.select(
            F.col("feature").cast("int").alias("region"), p["sa4_code_2021"].alias("code"), p["sa4_name_2021"].alias("name"),
            p["state_name_2021"].alias("state"), half_up(p["area_albers_sqkm"].try_cast("double")).alias("area_km2"))
        if self.population is None:
            return listed.withColumn("population", F.lit(0.0))
        people = self.population.select("code", F.col("value").alias("population"))
        return listed.join(people, "code", "left").fillna(0, ["population"])

    def region_result(self) -> DataFrame:
        placed = self.site_records.select("SITE_ID", F.when(F.col("region") >= 0, F.col("region")).alias("region"))
        rolled = R.region_rollup(placed, self.tenants, self.region_table(), site="SITE_ID", region="region")
        rate = half_up(F.try_divide(F.col("sites").cast("double"), F.col("population")) * 1e5) / F.lit(10.0)
        rated = rolled.withColumn("per_ten_k", rate).withColumnRenamed("top_holder", "root")
        return self.published(rated).withColumnRenamed("entity_id", "top_holder")

    def region_classes(self) -> DataFrame:
        placed = self.site_records.filter("region >= 0").select("SITE_ID", "region")
        return R.region_classes(skew_join(self.tenants, placed, "SITE_ID"), "region")

    def site_result(self) -> DataFrame:
        return self.publishable.select("SITE_ID", half_up(F.col("lat"), 5).alias("lat"), half_up(F.col("lon"), 5).alias("lon"),
                                       "class", "devices", "accuracy", "holders", "region")

    @cached_property
    def published_tenants(self) -> DataFrame:
        return durable(skew_join(self.tenants, self.publishable.select("SITE_ID"), "SITE_ID", "left_semi"))

    def tenancy_pairs(self) -> DataFrame:
        named = self.published_tenants.filter(~F.col("person"))
        return N.class_pairs(named, "SITE_ID", self.entities.select("class").distinct())

    def tenancy_sites(self) -> DataFrame:
        named = self.published_tenants.filter(~F.col("person")).groupBy("SITE_ID").agg(F.count(F.lit(1)).alias("n"))
        listed = N.crowded_sites(self.publishable, "SITE_ID", 6, 400, named)
        return listed.select("SITE_ID", "name", "state", half_up(F.col("lat"), 5).alias("lat"),
                             half_up(F.col("lon"), 5).alias("lon"), "devices", "licences", "holders", "named")

    def tenancy_tenants(self) -> DataFrame:
        at = N.tenant_list(self.tenancy_sites(), self.published_tenants, "SITE_ID")
        return self.published(at.withColumnRenamed("holder", "root"))

    def block_result(self) -> DataFrame:
        areas = K.named_areas(self.t["auth_spectrum_area"], "AREA_NAME", self.rules.placeholder_area)
        areas = areas.groupBy("LICENCE_NO", "AREA_CODE").agg(F.max("AREA_NAME").alias("market"))
        joined = self.blocks.join(areas, ["LICENCE_NO", "AREA_CODE"])
        held = K.block_holdings(joined, market="market", band="band", holder="root", licence="LICENCE_NO",
                                lower=F.col("lower"), upper=F.col("upper"))
        return self.published(held)

    def block_naive(self) -> DataFrame:
        return self.published(K.naive_and_one_area(self.blocks, holder="root", area="AREA_CODE",
                                                   width=F.col("lower") + F.col("upper")))

    def expiry(self) -> DataFrame:
        return R.year_histogram(self.licences.filter("granted"), F.col("DATE_OF_EXPIRY"), "never", "licences")

    def vintage(self) -> DataFrame:
        kind = F.when(F.col("SV_ID") == self.rules.spectrum_service, F.lit("spectrum")).otherwise(F.lit("apparatus"))
        return R.vintage(self.devices, F.col("AUTHORISATION_DATE"), kind, ["apparatus", "spectrum"])

    def station_classes(self) -> DataFrame:
        used = R.histogram(self.devices.filter(F.col("CLASS_OF_STATION_CODE").isNotNull()),
                           F.col("CLASS_OF_STATION_CODE").alias("code"))
        return J.lookup(used, "code", self.t["class_of_station"], "CODE", "DESCRIPTION", "description")

    def register_totals(self) -> DataFrame:
        """Device totals in one row: all, transmit, receive, missing value, blank site, beyond the axis."""
        return R.scalar_totals(self.devices, self.licences, "LICENCE_NO", "granted", {
            "tx": F.col("tx"), "rx": F.col("DEVICE_TYPE") == "R", "no_value": F.col("FREQUENCY").isNull(),
            "blank_site": F.col("SITE_ID").isNull(), "beyond": F.col("FREQUENCY") >= self.rules.beyond})

    def conditions(self) -> DataFrame:
        """What the documented join of the condition texts matches, and what the other key does."""
        keys = self.t["applic_text_block"].filter(F.col("LICENCE_NO").isNotNull()) \
            .groupBy(F.col("LICENCE_NO").alias("k")).agg(F.count(F.lit(1)).alias("texts"))
        keys = durable(keys)
        devices = self.devices.select(F.col("DEVICE_REGISTRATION_IDENTIFIER").alias("k"), "LICENCE_NO").filter("k is not null")
        per = devices.groupBy("k", "LICENCE_NO").agg(F.count(F.lit(1)).alias("n"))
        per = skew_join(per, keys.select("k"), "k", "left_semi", probe=devices)
        reached = durable(per.groupBy("LICENCE_NO").agg(F.sum("n").alias("n")))
        documented = keys.join(self.licences.select(F.col("LICENCE_NO").alias("k")), "k", "left_semi")
        return Q.reconcile(
            texts=self.t["applic_text_block"].agg(F.count(F.lit(1))), keys=keys.agg(F.count(F.lit(1))),
            device_matches=reached.agg(F.coalesce(F.sum("n"), F.lit(0))),
            licences_reached=reached.agg(F.count(F.lit(1))), documented_matches=documented.agg(F.count(F.lit(1))))

    def health(self) -> DataFrame:
        """Six defects with numerator, denominator and share."""
        rules = self.rules
        live = self.live_sites.select("SITE_ID", F.lit(True).alias("live"))
        year = str(rules.issue_year) if rules.issue_year else None
        return R.ratio_table({
            "sites with no device": R.share_bar(self.t["site"].join(live, "SITE_ID", "left"), F.col("live").isNull()),
            "receiver rows": R.share_bar(self.devices, F.col("DEVICE_TYPE") == "R"),
            "spectrum licence rows": R.share_bar(self.devices, F.col("SV_ID") == rules.spectrum_service),
            "clients without category": R.share_bar(self.t["client"], F.col("CAT_ID").isNull()),
            "issued this year": R.share_bar(self.licences, year_token(F.col("DATE_ISSUED"), "blank") == year),
            "sites of unknown accuracy": R.share_bar(self.site_records, F.col("accuracy") == len(rules.accuracy))})

    # --- gates ------------------------------------------------------------------------------------

    def flags_again(self) -> DataFrame:
        """Records with the person flag recomputed from client and licence rows, lifted to the merged entity.

        Of what the results were made from, only which records belong together is taken over.
        """
        held = self.t["licence"].groupBy("CLIENT_NO").agg(F.count(F.lit(1)).alias("_held"))
        named = self.t["client"].join(held, "CLIENT_NO", "left").withColumn("_key", name_key(F.col("LICENCEE")))
        own = E.person_flag(F.col("CLIENT_TYPE_ID") == self.rules.person_type, F.col("ACN").isNotNull(),
                            F.coalesce("_held", F.lit(0)), F.col("_key"), self.rules.not_personal)
        records = named.select("CLIENT_NO", "LICENCEE", own.alias("own")).join(self.clients.select("CLIENT_NO", "root"), "CLIENT_NO")
        lifted = records.groupBy("root").agg(F.bool_or("own").alias("any"))
        return records.join(lifted, "root").select("CLIENT_NO", "LICENCEE", F.col("own").alias("person"), F.col("any").alias("entity_person"))

    def person_only_again(self, flags: DataFrame) -> DataFrame:
        """Sites whose every device is a person's, from device, licence and client rows."""
        owner = self.t["licence"].select("LICENCE_NO", "CLIENT_NO").join(flags.select("CLIENT_NO", "entity_person"), "CLIENT_NO")
        per = self.t["device_details"].filter(F.col("SITE_ID").isNotNull()).select("SITE_ID", "LICENCE_NO").distinct()
        seen = skew_join(per, owner.select("LICENCE_NO", "entity_person"), "LICENCE_NO", probe=self.t["device_details"])
        return seen.groupBy("SITE_ID").agg(F.bool_and("entity_person").alias("p")).filter("p")

    def coarse_places(self) -> DataFrame:
        """Sites whose region would be another on boundaries that are fit for drawing only."""
        placed = self.site_records.select("SITE_ID", "lat", "lon", "region").filter("SITE_ID is not null")
        coarse = G.coarsened(polygons.parts(self.regions), self.rules.drawing_grid)
        drawn = G.locate(placed, coarse, id="SITE_ID", lat="lat", lon="lon", region="drawn")
        return placed.join(drawn, "SITE_ID").filter(F.col("region") != F.col("drawn"))

    def check_sources(self, results: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """The tables the gates run on: sources, and comparisons of a result with its source."""
        r = dict(results) if results else self.results()
        t = self.t
        count = F.count(F.lit(1))
        flags = self.flags_again()
        person_only = self.person_only_again(flags)
        person_names = flags.filter("person").select(F.trim("LICENCEE").alias("name")).filter(F.length("name") > 4)
        matched = skew_join(t["device_details"], t["licence"].select("LICENCE_NO"), "LICENCE_NO", "left_semi")
        top = r["band_top_holders"].groupBy("band").agg(F.max("rows").alias("most"), F.sum("rows").alias("listed"))
        recounted = self.rules.bands.assign(t["device_details"], "FREQUENCY").select("LICENCE_NO", "band").distinct() \
            .join(t["licence"].select("LICENCE_NO", "CLIENT_NO"), "LICENCE_NO") \
            .join(self.clients.select("CLIENT_NO", "root"), "CLIENT_NO") \
            .select("band", "root").distinct().groupBy("band").agg(count.alias("n"))
        refs = [(r[name], "entity_id", name) for name in ("band_top_holders", "tenancy_tenants", "blocks")]
        if self.boundaries is not None:
            refs.append((r["regions"], "top_holder", "regions"))
        return {
            "device_details": t["device_details"], "licence": t["licence"], "client": t["client"], "site": t["site"],
            "blocks": t["auth_spectrum_freq"],
            "sums": Q.reconcile(
                clients=t["client"].agg(count), merged=self.entities.agg(F.sum("records")),
                licences=t["licence"].agg(count), held=self.entities.agg(F.sum("licences")),
                named=r["entities"].agg(F.sum("licences")), withheld=r["individuals"].select("licences"),
                devices=t["device_details"].agg(count), attributed=self.totals.agg(F.sum("devices")),
                serviced=R.histogram(matched, "SV_ID").agg(F.sum("rows")),
                sites=t["site"].agg(count), placed=self.site_records.agg(count),
                site_keys=self.site_records.select("SITE_ID").filter("SITE_ID is not null").distinct().agg(count)),
            "orphan_clients": J.orphans(t["licence"], t["client"], "CLIENT_NO"),
            "orphan_licences": J.orphans(t["device_details"], t["licence"], "LICENCE_NO"),
            "undocumented": J.orphans(t["device_details"].withColumnRenamed("CLASS_OF_STATION_CODE", "CODE"),
                                      t["class_of_station"], "CODE"),
            "status_text": J.disagreement(t["licence"], "STATUS", "STATUS_TEXT", t["licence_status"], "STATUS", "STATUS_TEXT"),
            "assignments": B.assignment_ratio(self.devices, ["LICENCE_NO", "SITE_ID", "FREQUENCY", "DEVICE_TYPE"], "SITE_ID"),
            "broadcast": J.typed_contract(t["licence"], "BSL_NO", F.col("SV_ID").isin(*self.rules.broadcast_services),
                                          t["bsl"], "BSL_NO"),
            "areas": J.composite_cardinality(t["auth_spectrum_freq"], ["LICENCE_NO", "AREA_CODE"]),
            "conditions": r["conditions"],
            "leaked_sites": J.common(person_only, r["sites"], F.col("SITE_ID"), F.col("SITE_ID")),
            "leaked_names": J.common(person_names, r["entities"], F.col("name"), F.trim("name")),
            "leaked_places": J.common(person_names, r["site_names"], F.upper("name"), F.upper(F.trim("name"))),
            "surviving_names": J.common(person_only.join(self.site_records, "SITE_ID"), r["site_names"], F.col("name"), F.col("name")),
            "references": Q.unresolved(J.references(*refs), "ref", r["entities"], "entity_id"),
            "holders_in_band": top.join(r["bands"], "band"),
            "recount": Q.recount(r["bands"].filter("rows > 0"), recounted.withColumnRenamed("n", "holders"), ["band"], "holders"),
            "site_regions": self.site_records,
            **({} if self.boundaries is None or self.rules.drawing_grid is None else {"coarse_places": self.coarse_places()}),
        }

    def checks(self) -> list[Q.Check]:
        """Gates that hold for any snapshot. Pinned figures of one snapshot are added by the caller."""
        zero = F.coalesce(F.sum("rows"), F.lit(0))
        some = F.count(F.lit(1))
        return [
            Q.equals("merge keeps every record", "sums", F.sum(F.col("clients") - F.col("merged")), 0),
            Q.equals("merge keeps every licence", "sums", F.sum(F.col("licences") - F.col("held")), 0),
            Q.equals("named and withheld are all", "sums", F.sum(F.col("licences") - F.col("named") - F.col("withheld")), 0),
            Q.equals("every device has a holder", "sums", F.sum(F.col("devices") - F.col("attributed")), 0),
            Q.equals("services sum to the file", "sums", F.sum(F.col("devices") - F.col("serviced")), 0),
            Q.equals("every site is placed or unplaced once", "sums", F.sum(F.col("sites") - F.col("placed")), 0),
            Q.equals("site keys are unique", "sums", F.sum(F.col("sites") - F.col("site_keys")), 0),
            Q.plausible("station classes are documented", "undocumented", zero, 0, 0),
            Q.plausible("block areas have one block", "areas", F.max("most"), 1, 1),
            Q.in_range("dates are not older than the register", "licence", F.coalesce(F.min(F.year("DATE_ISSUED")), F.lit(9999)),
                       lo=self.rules.first_year),
            Q.equals("licences without a client", "orphan_clients", zero, 0),
            Q.equals("devices without a licence", "orphan_licences", zero, 0),
            Q.equals("status text agrees", "status_text", F.sum("differing"), 0),
            Q.equals("sites have coordinates", "site", Q.violations(F.col("LATITUDE").isNotNull() & F.col("LONGITUDE").isNotNull()), 0),
            Q.in_range("blocks are in hertz", "blocks", F.min("LW_FREQUENCY_START"), lo=1e6),
            Q.equals("documented join matches nothing", "conditions", F.max("documented_matches"), 0),
            Q.equals("typed join is complete", "broadcast", F.sum(F.col("listed_keys") - F.col("typed_matches")), 0),
            Q.in_range("rows per assignment", "assignments", F.max(F.col("rows") / F.col("assignments")), lo=1.0),
            Q.equals("no person-only site is shown", "leaked_sites", some, 0),
            Q.equals("no person is named", "leaked_names", some, 0),
            Q.equals("no person names a place", "leaked_places", some, 0),
            Q.plausible("names shared with shown places", "surviving_names", some, 0, 20),
            Q.equals("references resolve", "references", some, 0),
            Q.equals("no holder exceeds its band", "holders_in_band", Q.violations(F.col("most") <= F.col("rows")), 0),
            Q.equals("listed holders fit the band", "holders_in_band", Q.violations(F.col("listed") <= F.col("rows")), 0),
            *([] if self.boundaries is None else [
                Q.plausible("sites are in a region", "site_regions", Q.share_of(F.col("region") >= 0), *self.rules.match_rate)]),
            # Had the places been found on the boundaries of the drawing, they would agree with it throughout.
            *([] if self.boundaries is None or self.rules.drawing_grid is None else [
                Q.in_range("places are not those of the drawing", "coarse_places", some, lo=1)]),
            Q.equals("holders recounted", "recount", Q.violations(F.col("published").eqNullSafe(F.col("recomputed"))), 0),
        ]

    def report(self, extra: Sequence[Q.Check] = (), results: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """The check report. ``extra`` pins figures of one snapshot on the same sources."""
        return Q.run_checks(self.check_sources(results), [*self.checks(), *extra])


def rows_with_comma(columns: Sequence[str]) -> Column:
    """Aggregate: rows in which any of the columns holds a comma."""
    return F.count_if(any_contains([F.col(c) for c in columns], ","))
