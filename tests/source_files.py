"""Writes a small, clean set of the twelve delimited source files."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal
from pathlib import Path

from marginlens.sources.schemas import layout

PRODUCTS = [
    # key, sku, subcategory, name, cost, list price, dealer price, status
    (1, "BK-1", "1", "Road bike", "100.0000", "200.0000", "120.0000", ""),
    (2, "BK-1", "1", "Road bike v2", "110.0000", "n/a", "125.0000", "Current"),
    (3, "HL-1", "2", 'Helmet 26" "M"', "10.0000", "30.0000", "", "Current"),
]
SUBCATEGORIES = [(1, "Road Bikes", 1), (2, "Helmets", 2)]
CATEGORIES = [(1, "Bikes"), (2, "Accessories")]
PROMOTIONS = [(1, "No Discount", "0", "No Discount"), (2, "Volume 11 to 14", "0.05", "Volume Discount"), (3, "Launch", "0.2", "New Product")]
RESELLERS = [(1, "10", "Valley Cycles", "Warehouse", "25"), (2, "11", " Hill Bikes ", "Value Added Reseller", "unknown")]
CUSTOMERS = [(101, "10", "Ada", "Lovelace"), (102, "99", "Alan", "Turing")]
PLACES = [("10", "Paris", "Seine", "France", "1"), ("11", "Lyon", "Rhone", "France", "1")]


def line(names: list[str], **values) -> str:
    return "|".join("" if values.get(n) is None else str(values[n]) for n in names)


def sale(party: str, key: int, number: str, order_line: int, product: int, promotion: int, day: str, quantity: int, price: str, cost: str) -> dict:
    rate = Decimal(next(p[2] for p in PROMOTIONS if p[0] == promotion))
    gross = quantity * Decimal(price)
    discount = (gross * rate).quantize(Decimal("0.0001"))
    return {
        "ProductKey": product, party: key, "PromotionKey": promotion, "SalesTerritoryKey": 1, "SalesOrderNumber": number,
        "SalesOrderLineNumber": order_line, "OrderQuantity": quantity, "UnitPrice": price, "ExtendedAmount": gross,
        "UnitPriceDiscountPct": rate, "DiscountAmount": discount, "ProductStandardCost": cost,
        "TotalProductCost": quantity * Decimal(cost), "SalesAmount": gross - discount, "OrderDate": f"{day} 00:00:00",
    }


RESELLER_SALES = [
    ("ResellerKey", 1, "SO1", 1, 1, 1, "2020-03-10", 10, "120.0000", "100.0000"),
    ("ResellerKey", 1, "SO1", 2, 3, 2, "2020-03-10", 12, "20.0000", "10.0000"),
    ("ResellerKey", 2, "SO2", 1, 1, 3, "2020-07-01", 5, "120.0000", "100.0000"),
    ("ResellerKey", 1, "SO3", 1, 2, 1, "2021-02-01", 8, "125.0000", "110.0000"),
    ("ResellerKey", 2, "SO4", 1, 2, 3, "2021-05-20", 20, "125.0000", "110.0000"),
]
INTERNET_SALES = [
    ("CustomerKey", 101, "SO5", 1, 1, 1, "2020-04-01", 1, "200.0000", "100.0000"),
    ("CustomerKey", 102, "SO6", 1, 3, 1, "2021-04-01", 2, "30.0000", "10.0000"),
    ("CustomerKey", 102, "SO6", 2, 2, 1, "2021-04-01", 1, "210.0000", "110.0000"),
]


def write_source_files(folder: Path) -> str:
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(731)]
    content = {
        "FactResellerSales": [sale(*s) for s in RESELLER_SALES],
        "FactInternetSales": [sale(*s) for s in INTERNET_SALES],
        "DimProduct": [
            dict(ProductKey=k, ProductAlternateKey=sku, ProductSubcategoryKey=sub, EnglishProductName=name, ModelName=name,
                 StandardCost=cost, ListPrice=listed, DealerPrice=dealer, Status=status)
            for k, sku, sub, name, cost, listed, dealer, status in PRODUCTS
        ],
        "DimProductSubcategory": [
            dict(ProductSubcategoryKey=k, EnglishProductSubcategoryName=n, ProductCategoryKey=c) for k, n, c in SUBCATEGORIES
        ],
        "DimProductCategory": [dict(ProductCategoryKey=k, EnglishProductCategoryName=n) for k, n in CATEGORIES],
        "DimDate": [
            dict(DateKey=f"{d:%Y%m%d}", FullDateAlternateKey=d, EnglishMonthName=f"{d:%B}", MonthNumberOfYear=d.month,
                 CalendarQuarter=(d.month + 2) // 3, CalendarYear=d.year)
            for d in days
        ],
        "DimReseller": [
            dict(ResellerKey=k, GeographyKey=g, ResellerName=n, BusinessType=b, NumberEmployees=e, YearOpened="1999", Phone="555-0100")
            for k, g, n, b, e in RESELLERS
        ],
        "DimCustomer": [
            dict(CustomerKey=k, GeographyKey=g, FirstName=f, LastName=n, EmailAddress=f"{f}@example.org") for k, g, f, n in CUSTOMERS
        ],
        "DimGeography": [
            dict(GeographyKey=g, City=c, StateProvinceName=s, EnglishCountryRegionName=n, SalesTerritoryKey=t)
            for g, c, s, n, t in PLACES
        ],
        "DimSalesTerritory": [
            dict(SalesTerritoryKey="1", SalesTerritoryRegion="France", SalesTerritoryCountry="France", SalesTerritoryGroup="Europe")
        ],
        "DimPromotion": [
            dict(PromotionKey=k, EnglishPromotionName=n, DiscountPct=r, EnglishPromotionType=t, MinQty="0", MaxQty="")
            for k, n, r, t in PROMOTIONS
        ],
        "DimCurrency": [dict(CurrencyKey=1, CurrencyAlternateKey="EUR", CurrencyName="Euro")],
    }
    folder.mkdir(parents=True, exist_ok=True)
    for name, rows in content.items():
        names = layout(name).names
        (folder / f"{name}.csv").write_text("".join(line(names, **row) + "\n" for row in rows), encoding="utf-8")
    return str(folder)
