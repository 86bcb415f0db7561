"""Decisions that depend on earlier decisions of the same batch: one ordered fold an island of rivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlour.functions.islands import islands

_PLACE = "array<struct<owner:bigint,party:bigint,s:timestamp_ntz,e:timestamp_ntz,name:string>>"
_OUT = "array<struct<req_id:bigint,accepted:boolean,clash:struct<s:timestamp_ntz,owner:bigint,e:timestamp_ntz,name:string>>>"


def serve_in_order(requests: DataFrame) -> DataFrame:
    """(req_id, accepted, clash) of requests for places in time, served by req_id.

    ``requests``: (req_id, grp, owner, party, s, e, name, blocked, holds, old_s, old_e, old_name). A request asks that
    ``owner`` have the place [s, e) of group ``grp``; it clashes with every place that an owner of another party has then,
    and is accepted if there is none and it is not ``blocked``. An accepted request gives up the place that its owner had
    and, if it ``holds``, has the new one from then on. An owner that is asked for has [old_s, old_e) at first (none if
    null). ``clash`` is the earliest place met.

    Only requests whose owners' places, old and asked for, hang together in time can touch one another: such islands are
    folded each on its own, whatever the length of the chains in them, in a fixed number of jobs. A group with very many
    requests is dealt over its islands; one island is served in sequence, as its requests depend on one another."""
    reach = requests.groupBy("grp", "owner").agg(
        F.min(F.least("s", "e", "old_s", "old_e")).alias("lo"), F.max(F.greatest("s", "e", "old_s", "old_e")).alias("hi"))
    found = islands(reach, "grp", "lo", "hi").select("grp", "owner", "island")
    element = F.struct("req_id", "owner", "party", "s", "e", "name", "blocked", "holds", "old_s", "old_e", "old_name")
    batches = requests.join(found, ["grp", "owner"]).groupBy("grp", "island").agg(F.sort_array(F.collect_list(element)).alias("asked"))

    def place(x, s: str, e: str, name: str):
        return F.struct(x["owner"].alias("owner"), x["party"].alias("party"), x[s].alias("s"), x[e].alias("e"), x[name].alias("name"))

    at_first = F.array_distinct(F.transform(F.filter("asked", lambda x: x["old_s"].isNotNull() & x["old_e"].isNotNull()), lambda x: place(x, "old_s", "old_e", "old_name")))

    def step(state, x):
        met = F.filter(state["places"], lambda p: (p["owner"] != x["owner"]) & (p["party"] != x["party"]) & (p["s"] < x["e"]) & (p["e"] > x["s"]))
        first = F.array_min(F.transform(met, lambda p: F.struct(p["s"], p["owner"], p["e"], p["name"])))

        def decided(clash):
            ok = clash.isNull() & ~x["blocked"]
            rest = F.filter(state["places"], lambda p: p["owner"] != x["owner"])
            held = F.when(x["holds"], F.concat(rest, F.array(place(x, "s", "e", "name")))).otherwise(rest)
            return F.struct(F.when(ok, held).otherwise(state["places"]).cast(_PLACE).alias("places"),
                            F.concat(state["out"], F.array(F.struct(x["req_id"].alias("req_id"), ok.alias("accepted"), clash.alias("clash")))).cast(_OUT).alias("out"))

        return F.transform(F.array(first), decided)[0]

    empty = F.struct(at_first.cast(_PLACE).alias("places"), F.array().cast(_OUT).alias("out"))
    return batches.select(F.explode(F.aggregate("asked", empty, step, lambda state: state["out"])).alias("o")).select("o.req_id", "o.accepted", "o.clash")
