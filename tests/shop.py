"""A clean daily shop: three customers, two products, every day for fourteen months; cases edit it."""

import datetime as dt

from tillscope.plans.sales_lines import Answers, Mapping, build_sales_lines

FIELDS = {"transaction_date": "Date", "quantity": "Qty", "unit_price": "Price", "product_name": "Product", "customer": "Cust"}
SCHEMA = "line_no bigint, Date string, Qty string, Price string, Product string, Cust string, Invoice string, Type string, SKU string"


def clean_rows(start=dt.date(2023, 1, 1), end=dt.date(2024, 2, 29)):
    rows, day = [], start
    while day <= end:
        for who in ("Ann", "Bo", "Cy"):
            for product, price in (("Mug", "10.00"), ("Tea", "4.00")):
                rows.append(dict(Date=day.isoformat(), Qty="1", Price=price, Product=product, Cust=who,
                                 Invoice=f"{day.isoformat()}-{who}", Type=None, SKU=None))
        day += dt.timedelta(days=1)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, r["Date"], r["Qty"], r["Price"], r["Product"], r["Cust"], r.get("Invoice"), r.get("Type"), r.get("SKU")) for i, r in enumerate(rows)], SCHEMA)


def lines(spark, rows, answers=None, extra=None, scope=None):
    return build_sales_lines(frame(spark, rows), Mapping({**FIELDS, **(extra or {})}), scope or [], answers or Answers())
