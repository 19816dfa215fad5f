"""Stand-in views for the warehouse inputs of the analyses.

The analyses read marketing tables (experiment sessions, installs, click
revenue, budgets, cases, revenue facts, keyword lists).  Each is expressed
here as a projection of the driver tables, so every query's work grows with
those tables.  ``FIXTURES.md`` documents each mapping; ``adlytics.oracle.views``
holds the same mappings written independently in DuckDB SQL.

All views are lazy DataFrames: nothing is read until an action runs, and
column pruning / filter pushdown reach the parquet scan through them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlytics.sources.tables import Tables

E = F.col


def _case(expr: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(expr == F.lit(k), F.lit(v)) if out is None else out.when(expr == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def _str(c: Column) -> Column:
    return c.cast("string")


# Fixed values of the stand-ins (must agree with the oracle views).
ARM_PREFIX = "arm"
TEST_ID = "exp1"
DEVICE_BY_MOD3 = {0: "Mobile", 1: "Desktop"}          # else 'Tablet'
SOURCE_BY_EVENT = {"click": "Clickout", "purchase": "Onsite-Booking", "view": "Onsite-Inquiry",
                   "signup": "Inline-Ad", "error": "Popunder"}
INSTALL_EVENT_BY_TYPE = {"signup": "install", "click": "af_skad_install", "view": "retargeting",
                         "error": "uninstall"}    # else 'other'
OVERLAY_CAMPAIGNS = ("overlay_deals", "overlay_deals_south")
LANGUAGE_BY_MOD8 = {0: "DE", 1: "EN", 2: "NL", 3: "IT", 4: "ES", 5: "FR", 6: "PL"}   # else 'SV'


class Views:
    """Builds the stand-in views over one data directory (cached per name)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)
        self._cache: dict[str, DataFrame] = {}

    def get(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = getattr(self, f"_build_{name}")()
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if hasattr(type(self), f"_build_{name}"):
            return self.get(name)
        raise AttributeError(name)

    def register(self, *names: str) -> None:
        for n in names:
            self.get(n).createOrReplaceTempView(n)

    # ------------------------------------------------------------------ A/B
    def _build_ab_sessions(self) -> DataFrame:
        e = self.t.events
        purchase = (E("event_type") == "purchase")
        return e.select(
            E("event_id").alias("session_id"),
            E("ts").alias("session_timestamp"),
            F.concat(F.lit(ARM_PREFIX), _str(E("user_id") % 2)).alias("id"),
            F.lit(TEST_ID).alias("test_id"),
            _case(E("event_id") % 3, DEVICE_BY_MOD3, "Tablet").alias("device_type"),
            E("user_id").alias("cookie_user_id"),
            F.when(E("user_id") % 3 == 0, "Returning Visitor").otherwise("New Visitor").alias("visitor_group"),
            F.when(purchase, E("value")).otherwise(F.lit(0.0)).alias("revenue"),
            F.when(purchase, 1).otherwise(0).alias("booking_quantity_direct_before_cancellations_onsite_booking"),
            F.when(purchase, 1).otherwise(0).alias("booking_quantity_direct_before_cancellations"),
            F.when(E("event_type") == "view", 1).otherwise(0).alias("searches"),
        )

    def _build_sessions(self) -> DataFrame:
        e = self.t.events
        m4 = E("user_id") % 4
        return e.select(
            E("event_id").alias("session_id"),
            E("ts").alias("session_timestamp"),
            F.when(E("event_type") == "signup", E("user_id")).alias("uref"),
            F.concat(F.lit("site"), _str(m4), F.when(m4 == 0, ".de").otherwise(".ch")).alias("site_id"),
            _case(E("user_id") % 7, {0: "vacaro", 1: "villamo", 2: "domiva"}, "main").alias("legal_entity_short_name"),
            F.concat(F.when(E("user_id") % 2 == 0, "google/ch/").otherwise("bing/ch/"), _str(E("user_id"))).alias("adword_30_days"),
            F.concat(F.lit("camp"), _str(E("user_id") % 3)).alias("campaign_30_days"),
            F.when(E("event_id") % 3 == 0, F.concat(F.lit("g"), _str(E("event_id")))).alias("google_click_id_30_days"),
            F.when(E("event_id") % 3 == 1, F.concat(F.lit("m"), _str(E("event_id")))).alias("microsoft_click_id_30_days"),
        )

    def _build_crm_users(self) -> DataFrame:
        # One row per user: a grouped aggregate with map-side partial aggregation.
        e = self.t.events
        return (e.groupBy("user_id")
                .agg(F.min("ts").alias("first_ts"))
                .select(
                    E("user_id").alias("uref"),
                    F.date_add(F.to_date("first_ts"), (E("user_id") % 20).cast("int")).alias("registration_date"),
                    (E("user_id") % 2 == 0).alias("is_subscriber"),
                    F.concat(F.lit("src"), _str(E("user_id") % 5)).alias("origin_source"),
                ))

    def _build_crm_modals(self) -> DataFrame:
        e = self.t.events.filter(E("event_type").isin("signup", "click"))
        names = ["account_subscription_apple", "account_subscription_facebook",
                 "account_subscription_google", "account_subscription_email",
                 "account_creation_apple", "account_creation_facebook",
                 "account_creation_google", "account_creation_email"]
        counters = [F.when(E("event_id") % 8 == i, 1).otherwise(0).alias(n) for i, n in enumerate(names)]
        return e.select(
            E("event_id").alias("session_id"),
            E("ts").alias("session_timestamp"),
            F.when(E("user_id") % 5 != 0, '["exp1"]').otherwise('["other"]').alias("test_ids"),
            *counters,
        )

    def _build_interactions(self) -> DataFrame:
        e = self.t.events.filter(E("event_type") == "click")
        one = e.select(
            (E("event_id") - E("event_id") % 3).alias("session_id"),
            F.when(E("event_id") % 4 != 3, "overlay_cta_click")
             .otherwise("install_overlay_close").alias("metric_name"),
            F.when(E("user_id") % 3 != 1, "install_overlay").otherwise("other").alias("se_category"),
            E("event_id").alias("interactions_key"),
            E("ts").alias("interaction_timestamp"),
        )
        # The event log holds duplicated deliveries; the flows must de-duplicate.
        return one.unionByName(one)

    def _build_installs(self) -> DataFrame:
        e = self.t.events
        android = (E("user_id") % 20 < 10)
        ev = _case(E("event_type"), INSTALL_EVENT_BY_TYPE, "other")
        m10 = E("user_id") % 10
        return e.select(
            E("ts").alias("install_time"),
            E("ts").alias("date"),
            ev.alias("event_name"),
            ev.alias("activity_kind"),
            F.when(android, "android").otherwise("ios").alias("os_name"),
            F.when(android, "com.app").otherwise("1104").alias("app_id"),
            F.when(m10 < 4, "organic").when(m10 < 6, "Facebook Ads").when(m10 < 8, "googleadwords_int")
             .otherwise("Apple Search Ads").alias("media_source"),
            _case(E("event_id") % 4, {0: OVERLAY_CAMPAIGNS[0], 1: OVERLAY_CAMPAIGNS[1]},
                  None).alias("_c"),
            E("event_id"),
            E("user_id").alias("tracker_id"),
            E("user_id").alias("app_user_id"),
        ).withColumn("campaign_name", F.coalesce(E("_c"), F.concat(F.lit("camp"), _str(E("event_id") % 4)))) \
         .drop("_c", "event_id")

    # --------------------------------------------------------------- delays
    def _build_uploads(self) -> DataFrame:
        # A sparse log from all signups: of each day the times of the largest and
        # of the smallest value, and the last time.
        e = self.t.events.filter(E("event_type") == "signup")
        day = e.groupBy(F.to_date("ts").alias("d")).agg(
            F.max_by("ts", F.struct("value", "event_id")).alias("a"), F.min_by("ts", F.struct("value", "event_id")).alias("b"),
            F.max("ts").alias("c"))
        return day.select(F.explode(F.array("a", "b", "c")).alias("export_updated_at_utc")).distinct()

    def _build_ads_report(self) -> DataFrame:
        e = self.t.events
        return (e.filter((E("event_type") == "click") & (F.dayofmonth("ts") > 2))
                .select(E("ts").alias("date"), (E("value") * 0.1).alias("cost"),
                        F.lit(1).cast("bigint").alias("clicks"), E("value").alias("revenue")))

    # -------------------------------------------------------- click revenue
    def _build_micro_conversions(self) -> DataFrame:
        e = self.t.events
        m4 = E("event_id") % 4
        return e.select(
            E("event_id").alias("click_id"),
            E("event_id").alias("session_id"),
            E("ts").alias("click_id_timestamp"),
            _str(E("user_id")).alias("provider_id"),
            E("event_type").alias("site_id"),
            _str(E("event_id") % 2).alias("device_type"),
            _str(F.dayofmonth("ts") % 5).alias("offer_bidding_tags"),
            E("value").alias("revenue_cpc"),
            E("value").alias("revenue_final"),
            (E("value") * 200).alias("ecpc"),
            _case(E("event_type"), SOURCE_BY_EVENT).alias("click_id_source"),
            F.when(E("event_id") % 3 == 0, F.concat(F.lit("g"), _str(E("event_id")))).alias("session_google_click_id_30_days"),
            F.when(E("event_id") % 3 == 1, F.concat(F.lit("m"), _str(E("event_id")))).alias("session_microsoft_click_id_30_days"),
            F.when(m4 != 0, E("value") * 0.8).alias("estimated_group_commission_after_cancellations_updated_eur"),
            F.when(m4 != 1, E("value") * 0.7).alias("estimated_commission_reported_after_cancellations_updated_eur"),
            F.when(m4 != 2, E("value") * 0.6).alias("estimated_group_commission_direct_after_cancellations_updated_eur"),
            F.when(~m4.isin(2, 3), E("value") * 0.5).alias("estimated_commission_reported_direct_after_cancellations_updated_eur"),
            (E("value") * 0.1).alias("revenue_add_ons"),
            F.lit(None).cast("double").alias("revenue_service_fee"),
            F.when(E("event_type") == "purchase", 1).otherwise(0).alias("booking_quantity_before_cancellations"),
        )

    def _build_google_clicks(self) -> DataFrame:
        e = self.t.events.filter(E("event_id") % 3 == 0)
        return e.select(
            F.concat(F.lit("g"), _str(E("event_id"))).alias("google_click_id"),
            F.concat(F.lit("acc"), _str(E("user_id") % 3)).alias("mkt_account_id"),
            E("ts").alias("mkt_date"),
        )

    def _build_unqualified_bookings(self) -> DataFrame:
        e = self.t.events.filter(E("event_type") == "purchase")
        return e.select(
            E("event_id").alias("session_id"),
            E("ts").alias("click_id_timestamp"),
            F.when(E("event_id") % 3 == 0, F.concat(F.lit("g"), _str(E("event_id")))).alias("session_google_click_id_30_days"),
            F.when(E("event_id") % 3 == 1, F.concat(F.lit("m"), _str(E("event_id")))).alias("session_microsoft_click_id_30_days"),
            E("value").alias("imputed_revenue_after_cancellations_adjusted"),
        )

    def _build_subscription_revenue(self) -> DataFrame:
        e = self.t.events.filter(E("event_type") == "view")
        return e.select(
            E("event_id").alias("click_id"),
            F.when(E("event_id") % 2 == 0, "B2C_limited_leads").otherwise("other").alias("subscription_type"),
            F.when(E("event_id") % 5 != 0, E("value") * 0.3).alias("subscription_revenue_direct_attribution"),
        )

    def _build_estimates(self) -> DataFrame:
        e = self.t.events.filter(E("event_type") == "purchase")
        return e.select(
            E("event_id").alias("click_id"),
            _str(E("user_id") % 5).alias("provider_id"),
            _str(E("user_id") % 3).alias("site_id"),
            _str(E("event_id") % 2).alias("device_type"),
            _str(E("user_id") % 4).alias("app_id"),
            E("ts").alias("click_id_timestamp"),
            (E("value") + 1).alias("actual_offsite_booking_rev"),
            (E("value") * (F.lit(0.8) + F.lit(0.04) * (E("event_id") % 11))).alias("estimated_offsite_booking_rev"),
        )

    # -------------------------------------------------------------- budgets
    def _build_budgets(self) -> DataFrame:
        li = self.t.lineitem
        return li.select(
            F.to_date("l_shipdate").alias("mkt_date"),
            E("l_orderkey").alias("id"),
            E("l_suppkey").alias("mkt_account_id"),
            # the last lines of an order run without a strategy
            F.when(E("l_linenumber") < 7, E("l_partkey") % 40).alias("bid_strategy_id"),
            (E("l_quantity") * 100).alias("day_budget"),
            (E("l_quantity") * 120).alias("recommended_budget_amount"),
            (E("l_extendedprice") * E("l_tax")).alias("conversions_value"),
            (E("l_extendedprice") * E("l_discount")).alias("mkt_cost"),
            E("l_linenumber").cast("bigint").alias("conversions"),
        )

    def _build_strategies(self) -> DataFrame:
        li = self.t.lineitem
        sid = E("l_partkey") % 40
        return li.select(
            F.to_date("l_shipdate").alias("mkt_date"),
            sid.alias("bidding_strategy_id"),
            F.when(sid % 2 == 0, "Target ROAS").otherwise("Maximize Conversion Value").alias("bidding_strategy_type"),
        )

    # ---------------------------------------------------------------- cases
    def _build_cases(self) -> DataFrame:
        li = self.t.lineitem.filter(E("l_returnflag") == "R")
        return li.select(
            (E("l_orderkey") * 10 + E("l_linenumber")).alias("case_id"),
            E("l_shipdate").alias("created_datetime"),
            F.when(E("l_linenumber") == 7, 1).otherwise(0).alias("owner_is_autoclose_queue"),
            F.when(E("l_partkey") % 10 == 0, "Sales").otherwise("Customer Service").alias("business_domain_channel"),
            _case(E("l_suppkey") % 8, LANGUAGE_BY_MOD8, "SV").alias("language_channel"),
            F.when(E("l_linestatus") == "F", "Payment issue").otherwise("Other").alias("sub_topic"),
        )

    def _build_conversions(self) -> DataFrame:
        o = self.t.orders
        return o.select(
            E("o_orderdate").alias("conversion_date"),
            E("o_orderkey").alias("on_site_order_id"),
            F.when(E("o_orderstatus") == "P", 1).otherwise(0).alias("is_platform_payment"),
        )

    def _build_inventory(self) -> DataFrame:
        li = self.t.lineitem
        return li.select(
            F.to_date("l_shipdate").alias("dt"),
            E("l_partkey").alias("offer_id"),
            F.when(E("l_returnflag") == "A", 1).otherwise(0).alias("offers_payment"),
        )

    # -------------------------------------------------------------- revenue
    def _build_dim_site(self) -> DataFrame:
        n = self.t.nation
        m7 = E("n_nationkey") % 7
        return n.select(
            F.concat(F.lit("site"), _str(E("n_nationkey")),
                     F.when(E("n_nationkey") % 2 == 0, ".de").otherwise(".ch")).alias("site_id"),
            F.when(m7 == 0, F.lit(None).cast("string")).when(m7 == 1, "vacaro").when(m7 == 2, "casalia")
             .otherwise("northstay").alias("legal_entity"),
        )

    def _build_main_revenues(self) -> DataFrame:
        # orders -> customer -> nation -> region.  customer / nation / region
        # are dimension tables; the planner broadcasts them when small, and
        # the size check is Spark's own (autoBroadcastJoinThreshold + AQE).
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
        c = self.t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
        n = self.t.nation.select("n_nationkey", "n_regionkey")
        r = self.t.region.select("r_regionkey", "r_name")
        j = (o.join(c, o.o_custkey == c.c_custkey)
              .join(n, E("c_nationkey") == E("n_nationkey"))
              .join(r, E("n_regionkey") == E("r_regionkey")))
        d = F.to_date("o_orderdate")
        return j.select(
            d.alias("date"),
            E("o_orderkey").alias("conversion_click_id"),
            F.concat(F.lit("site"), _str(E("n_nationkey")),
                     F.when(E("n_nationkey") % 2 == 0, ".de").otherwise(".ch")).alias("site_id"),
            E("r_name").alias("site_global_region"),
            (E("o_custkey") % 10 == 0).alias("inter_company_group"),
            F.when(E("c_mktsegment") == "HOUSEHOLD", "Click and lead deals").otherwise(E("c_mktsegment")).alias("deal_type"),
            F.lit(1).cast("bigint").alias("conversions"),
            E("o_totalprice").alias("est_revenue_before_cancellations"),
            F.when(E("o_orderstatus") == "F", F.lit(0.0)).otherwise(E("o_totalprice")).alias("est_revenue"),
            (E("o_totalprice") * 0.1).alias("revenue"),
            F.when(E("o_orderkey") % 3 == 0, F.date_add(d, 1)).otherwise(d).alias("date_ifrs"),
        )

    # ------------------------------------------------------------- keywords
    def _build_keyword_master(self) -> DataFrame:
        # One master row per part: several rows share a keyword (different
        # locations), as in a keyword master.
        p = self.t.part
        return p.select(
            F.when(E("p_size") % 2 == 0, "city").otherwise("region").alias("object_type"),
            F.concat(F.lit("tpl"), _str(E("p_size") % 3)).alias("template"),
            E("p_name").alias("keyword"),
            F.concat(F.when(E("p_size") % 2 == 0, "city").otherwise("region"), F.lit(" "), E("p_name")).alias("object_type_keyword"),
            E("p_partkey").alias("location_id"),
            E("p_type").alias("location_name"),
            F.lit("base").alias("word_form"),
            F.element_at(F.split(E("p_name"), " "), -1).alias("amenity_keyword"),
            E("p_brand").alias("prefix"),
            F.when(E("p_size") % 9 == 0, "True").otherwise("False").alias("is_blacklisted"),
            F.when(E("p_size") % 11 == 0, "True").otherwise("False").alias("is_blacklisted_amenity"),
            F.when(E("p_partkey") % 2 == 0, "DE").otherwise("US").alias("market"),
        )

    def _build_keyword_volume(self) -> DataFrame:
        p = self.t.part
        return p.select(
            E("p_name").alias("keyword"),
            F.when(E("p_partkey") % 2 == 0, "DE").otherwise("US").alias("market"),
            F.add_months(F.lit("2022-06-01").cast("date"), (E("p_partkey") % 18).cast("int")).alias("year_month"),
            E("p_size").cast("bigint").alias("google_search_volume"),
        )

    def _build_search_terms_raw(self) -> DataFrame:
        """Search-term report rows as raw text, the way the ad console
        exports them: thousands separators, ' --' for missing, percent and
        currency signs, mixed case and blanks around the term; several
        campaign rows per term, the keyword names plus unknown terms."""
        p = self.t.part
        k = E("p_partkey")
        term = (F.when(k % 3 == 0, F.upper("p_name"))
                 .when(k % 3 == 1, F.concat(F.lit(" "), E("p_name"), F.lit("  ")))
                 .otherwise(E("p_name")))
        term = F.when(k % 7 == 0, F.concat(term, F.lit(" extra"))).otherwise(term)

        def thousands(x: Column) -> Column:
            return F.when(x >= 1000, F.concat((x / 1000).cast("bigint").cast("string"), F.lit(","),
                                              F.lpad((x % 1000).cast("string"), 3, "0"))).otherwise(x.cast("string"))

        impr = E("p_size").cast("bigint") * 113
        cents = F.round(E("p_retailprice") * 100).cast("bigint")
        return p.select(
            term.alias("search_term"),
            thousands(impr).alias("impr"),
            E("p_size").cast("string").alias("clicks"),
            F.when(k % 5 == 0, " --").otherwise(F.concat((E("p_size") % 10).cast("string"), F.lit(".5%"))).alias("cr"),
            F.when(k % 6 == 0, " --").otherwise(F.concat((E("p_size") * 3).cast("string"), F.lit("%"))).alias("roas"),
            F.when(k % 4 == 0, " --").otherwise((E("p_size") % 3).cast("string")).alias("bookings"),
            F.concat(F.lit("€"), thousands((cents / 100).cast("bigint")), F.lit("."),
                     F.lpad((cents % 100).cast("string"), 2, "0")).alias("revenue"),
        )
