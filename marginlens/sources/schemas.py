"""Declared layouts of the delimited source files. The files carry no header, so column order is the contract."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# File names, column names, column order and column types of the source files.
TYPED_LAYOUTS = {
    "FactResellerSales": """
        ProductKey int, OrderDateKey int, DueDateKey int, ShipDateKey int, ResellerKey int, EmployeeKey int,
        PromotionKey int, CurrencyKey int, SalesTerritoryKey int, SalesOrderNumber string, SalesOrderLineNumber int,
        RevisionNumber int, OrderQuantity int, UnitPrice decimal(19,4), ExtendedAmount decimal(19,4),
        UnitPriceDiscountPct double, DiscountAmount decimal(19,4), ProductStandardCost decimal(19,4),
        TotalProductCost decimal(19,4), SalesAmount decimal(19,4), TaxAmt decimal(19,4), Freight decimal(19,4),
        CarrierTrackingNumber string, CustomerPONumber string, OrderDate timestamp, DueDate timestamp, ShipDate timestamp
    """,
    "FactInternetSales": """
        ProductKey int, OrderDateKey int, DueDateKey int, ShipDateKey int, CustomerKey int, PromotionKey int,
        CurrencyKey int, SalesTerritoryKey int, SalesOrderNumber string, SalesOrderLineNumber int, RevisionNumber int,
        OrderQuantity int, UnitPrice decimal(19,4), ExtendedAmount decimal(19,4), UnitPriceDiscountPct double,
        DiscountAmount decimal(19,4), ProductStandardCost decimal(19,4), TotalProductCost decimal(19,4),
        SalesAmount decimal(19,4), TaxAmt decimal(19,4), Freight decimal(19,4), CarrierTrackingNumber string,
        CustomerPONumber string, OrderDate timestamp, DueDate timestamp, ShipDate timestamp
    """,
    "DimProductSubcategory": """
        ProductSubcategoryKey int, ProductSubcategoryAlternateKey int, EnglishProductSubcategoryName string,
        SpanishProductSubcategoryName string, FrenchProductSubcategoryName string, ProductCategoryKey int
    """,
    "DimProductCategory": """
        ProductCategoryKey int, ProductCategoryAlternateKey int, EnglishProductCategoryName string,
        SpanishProductCategoryName string, FrenchProductCategoryName string
    """,
    "DimDate": """
        DateKey int, FullDateAlternateKey date, DayNumberOfWeek int, EnglishDayNameOfWeek string,
        SpanishDayNameOfWeek string, FrenchDayNameOfWeek string, DayNumberOfMonth int, DayNumberOfYear int,
        WeekNumberOfYear int, EnglishMonthName string, SpanishMonthName string, FrenchMonthName string,
        MonthNumberOfYear int, CalendarQuarter int, CalendarYear int, CalendarSemester int, FiscalQuarter int,
        FiscalYear int, FiscalSemester int
    """,
    "DimCurrency": "CurrencyKey int, CurrencyAlternateKey string, CurrencyName string",
}
TEXT_LAYOUTS = {
    "DimProduct": """
        ProductKey ProductAlternateKey ProductSubcategoryKey WeightUnitMeasureCode SizeUnitMeasureCode
        EnglishProductName SpanishProductName FrenchProductName StandardCost FinishedGoodsFlag Color SafetyStockLevel
        ReorderPoint ListPrice Size SizeRange Weight DaysToManufacture ProductLine DealerPrice Class Style ModelName
        LargePhoto EnglishDescription FrenchDescription ChineseDescription ArabicDescription HebrewDescription
        ThaiDescription GermanDescription JapaneseDescription TurkishDescription StartDate EndDate Status
    """,
    "DimReseller": """
        ResellerKey GeographyKey ResellerAlternateKey Phone BusinessType ResellerName NumberEmployees OrderFrequency
        OrderMonth FirstOrderYear LastOrderYear ProductLine AddressLine1 AddressLine2 AnnualSales BankName
        MinPaymentType MinPaymentAmount AnnualRevenue YearOpened
    """,
    "DimCustomer": """
        CustomerKey GeographyKey CustomerAlternateKey Title FirstName MiddleName LastName NameStyle BirthDate
        MaritalStatus Suffix Gender EmailAddress YearlyIncome TotalChildren NumberChildrenAtHome EnglishEducation
        SpanishEducation FrenchEducation EnglishOccupation SpanishOccupation FrenchOccupation HouseOwnerFlag
        NumberCarsOwned AddressLine1 AddressLine2 Phone DateFirstPurchase CommuteDistance
    """,
    "DimGeography": """
        GeographyKey City StateProvinceCode StateProvinceName CountryRegionCode EnglishCountryRegionName
        SpanishCountryRegionName FrenchCountryRegionName PostalCode SalesTerritoryKey IpAddressLocator
    """,
    "DimSalesTerritory": """
        SalesTerritoryKey SalesTerritoryAlternateKey SalesTerritoryRegion SalesTerritoryCountry SalesTerritoryGroup
        SalesTerritoryImage
    """,
    "DimPromotion": """
        PromotionKey PromotionAlternateKey EnglishPromotionName SpanishPromotionName FrenchPromotionName DiscountPct
        EnglishPromotionType SpanishPromotionType FrenchPromotionType EnglishPromotionCategory SpanishPromotionCategory
        FrenchPromotionCategory StartDate EndDate MinQty MaxQty
    """,
}

FILES = (*TYPED_LAYOUTS, *TEXT_LAYOUTS)


def layout(name: str) -> StructType:
    """Schema of one source file: typed landing, or all text to be cast safely by the model."""
    if name in TYPED_LAYOUTS:
        return StructType.fromDDL(TYPED_LAYOUTS[name])
    if name in TEXT_LAYOUTS:
        return StructType([StructField(column, StringType()) for column in TEXT_LAYOUTS[name].split()])
    raise KeyError(f"unknown source file: {name}")
