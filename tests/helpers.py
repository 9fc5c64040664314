"""Small builders for hand-made feed fixtures."""

from __future__ import annotations

from pyspark.sql.types import StringType

from psephos.sources import schemas
from psephos.sources.inputs import HouseInputs, SenateInputs

UNSET = object()


def frame(spark, schema, rows: list[dict]):
    """DataFrame of ``schema``; missing text fields are "" and missing numbers 0."""
    out = []
    for r in rows:
        vals = []
        for f in schema.fields:
            v = r.get(f.name, UNSET)
            if v is UNSET:
                v = "" if isinstance(f.dataType, StringType) else (0.0 if f.dataType.typeName() == "double" else 0)
            vals.append(v)
        out.append(tuple(vals))
    return spark.createDataFrame(out, schema)


def tcp_type_row(div, div_id, party, cand_id, votes=(0, 0, 0, 0, 0), **kw):
    o, a, p, pp, po = votes
    row = dict(
        StateAb=kw.pop("StateAb", "NSW"),
        DivisionID=div_id,
        DivisionNm=div,
        CandidateID=cand_id,
        Surname=f"S{cand_id}",
        GivenNm=f"G{cand_id}",
        PartyAb=party,
        PartyNm=f"Party {party}",
        OrdinaryVotes=o,
        AbsentVotes=a,
        ProvisionalVotes=p,
        PrePollVotes=pp,
        PostalVotes=po,
        TotalVotes=None if None in votes else sum(votes),
        Elected="N",
        HistoricElected="N",
    )
    row.update(kw)
    return row


def house(spark, fp_pp=(), fp_type=(), tcp_pp=(), tcp_type=(), enrolment=()):
    return HouseInputs(
        fp_pp=frame(spark, schemas.HOUSE_FP_PP, list(fp_pp)),
        fp_type=frame(spark, schemas.HOUSE_FP_TYPE, list(fp_type)),
        tcp_pp=frame(spark, schemas.HOUSE_TCP_PP, list(tcp_pp)),
        tcp_type=frame(spark, schemas.HOUSE_TCP_TYPE, list(tcp_type)),
        enrolment=frame(spark, schemas.ENROLMENT_DIV, list(enrolment)),
    )


def senate(spark, fp_div=(), fp_group=()):
    return SenateInputs(
        fp_div=frame(spark, schemas.SENATE_FP_DIV, list(fp_div)),
        fp_group=frame(spark, schemas.SENATE_FP_GROUP, list(fp_group)),
    )
