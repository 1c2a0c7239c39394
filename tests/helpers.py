"""Small frames in the shapes the operators take."""

from __future__ import annotations

import datetime as dt
import json

from tidemark.schemas import CHANGE, LOG_RECORD, ORDER_ROW

TS = dt.datetime(2026, 1, 1)


def order(order_id, event_id=None, status="created", amount=100):
    event_id = order_id if event_id is None else event_id
    return (order_id, f"order-{order_id}", event_id, 1, status, amount, TS, 7)


def orders(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], ORDER_ROW)


def image(offset, kind, row, partition=0, seq=0):
    names = {"+I": "insert", "-U": "update_before", "+U": "update_after", "-D": "delete"}
    return ("t", partition, offset, offset, seq, kind, names[kind], *row, 1)


def images(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], CHANGE)


def wire(row):
    names = [f.name for f in ORDER_ROW.fields]
    out = dict(zip(names, row, strict=True))
    out["updated_at"] = 1767225600000
    return out


def envelope(op, before=None, after=None, **extra):
    doc = {
        "before": wire(before) if before else None,
        "after": wire(after) if after else None,
        "source": {"table": "orders"},
        "op": op,
        "ts_ms": 5,
        **extra,
    }
    return json.dumps(doc).encode()


def log(spark, *values, partition=0):
    rows = [
        ("t", partition, i, 1000 + i, str(i).encode(), v if v is None or isinstance(v, bytes) else v.encode())
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, LOG_RECORD)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=str)
