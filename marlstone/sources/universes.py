"""Baskets of assets as small dimension tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

# fixed values: rosters by group, each "TICKER name"
CORE_EQUITY = {
    "Information Technology": ["AAPL Apple", "MSFT Microsoft", "NVDA NVIDIA", "INTC Intel", "CSCO Cisco Systems", "ORCL Oracle", "IBM IBM", "TXN Texas Instruments", "ADBE Adobe", "QCOM Qualcomm", "AMAT Applied Materials", "AMD Advanced Micro Devices"],
    "Health Care": ["JNJ Johnson & Johnson", "PFE Pfizer", "MRK Merck", "ABT Abbott Laboratories", "BMY Bristol-Myers Squibb", "LLY Eli Lilly", "AMGN Amgen", "UNH UnitedHealth", "MDT Medtronic"],
    "Financials": ["JPM JPMorgan Chase", "BAC Bank of America", "WFC Wells Fargo", "C Citigroup", "GS Goldman Sachs", "MS Morgan Stanley", "AXP American Express", "USB U.S. Bancorp", "PNC PNC Financial"],
    "Consumer Discretionary": ["AMZN Amazon", "HD Home Depot", "MCD McDonald's", "NKE Nike", "LOW Lowe's", "TGT Target", "SBUX Starbucks", "TJX TJX Companies"],
    "Consumer Staples": ["PG Procter & Gamble", "KO Coca-Cola", "PEP PepsiCo", "WMT Walmart", "CL Colgate-Palmolive", "KMB Kimberly-Clark", "COST Costco"],
    "Industrials": ["CAT Caterpillar", "DE Deere", "HON Honeywell", "MMM 3M", "GE GE Aerospace", "BA Boeing", "LMT Lockheed Martin", "UPS United Parcel Service", "UNP Union Pacific"],
    "Energy": ["XOM Exxon Mobil", "CVX Chevron", "COP ConocoPhillips", "SLB SLB", "EOG EOG Resources", "OXY Occidental Petroleum", "HAL Halliburton"],
    "Materials": ["APD Air Products", "SHW Sherwin-Williams", "NUE Nucor", "ECL Ecolab", "PPG PPG Industries"],
    "Utilities": ["NEE NextEra Energy", "DUK Duke Energy", "SO Southern Company", "D Dominion Energy", "AEP American Electric Power", "EXC Exelon"],
    "Real Estate": ["SPG Simon Property Group", "PSA Public Storage", "O Realty Income", "AVB AvalonBay Communities"],
    "Communication Services": ["T AT&T", "VZ Verizon", "DIS Walt Disney", "CMCSA Comcast", "EA Electronic Arts"],
}
CROSS_ASSET = {
    "Equity": ["SPY S&P 500", "QQQ Nasdaq 100", "IWM US small cap", "EFA Developed ex-US", "EEM Emerging markets", "VGK Europe", "EWJ Japan"],
    "Rates": ["TLT US Treasury 20y+", "IEF US Treasury 7-10y", "SHY US Treasury 1-3y", "TIP US TIPS"],
    "Credit": ["LQD US investment grade", "HYG US high yield", "EMB EM sovereign USD"],
    "Commodities": ["GLD Gold", "SLV Silver", "DBC Broad commodities", "USO Crude oil"],
    "Real assets": ["VNQ US REITs"],
    "Currency": ["UUP US dollar index"],
}
SECTOR_ETFS = {"Sector ETF": ["XLB Materials", "XLE Energy", "XLF Financials", "XLI Industrials", "XLK Technology", "XLP Consumer Staples", "XLU Utilities", "XLV Health Care", "XLY Consumer Discretionary", "XLRE Real Estate", "XLC Communication Services"]}
CRYPTO_MAJORS = {
    "Store of value": ["BTCUSD Bitcoin"],
    "Smart contract L1": ["ETHUSD Ethereum", "SOLUSD Solana", "ADAUSD Cardano", "AVAXUSD Avalanche", "ALGOUSD Algorand"],
    "Interoperability L1": ["DOTUSD Polkadot", "ATOMUSD Cosmos"],
    "Payments": ["XRPUSD XRP", "LTCUSD Litecoin", "BCHUSD Bitcoin Cash"],
    "DeFi": ["LINKUSD Chainlink", "UNIUSD Uniswap", "AAVEUSD Aave"],
    "Exchange": ["BNBUSD BNB"],
    "Meme": ["DOGEUSD Dogecoin"],
}
CRYPTO_CORE = ["BTCUSD", "ETHUSD", "XRPUSD", "LTCUSD", "DOGEUSD", "ADAUSD", "BCHUSD"]
# fixed values: annotations of charts, "date label"
EVENTS = [
    "2000-03-10 Dot-com peak", "2001-09-11 9/11", "2002-10-09 Bear market low", "2007-08-09 Quant quake", "2008-09-15 Lehman", "2010-05-06 Flash crash",
    "2011-08-05 US downgrade", "2015-08-24 China devaluation", "2018-02-05 Volmageddon", "2020-03-23 COVID trough", "2022-06-16 2022 rate shock", "2023-03-10 SVB",
]


@dataclass(frozen=True)
class Member:
    ticker: str
    name: str
    group: str


@dataclass(frozen=True)
class Universe:
    """A fixed basket; ``limit`` is the longest run of missing rows to fill."""

    key: str
    title: str
    members: tuple[Member, ...]
    group_label: str
    asset_class: str = "equity"
    limit: int = 3
    caveats: str = ""

    def __len__(self) -> int:
        return len(self.members)

    @property
    def tickers(self) -> list[str]:
        return [m.ticker for m in self.members]

    @property
    def groups(self) -> dict[str, str]:
        return {m.ticker: m.group for m in self.members}

    @property
    def names(self) -> dict[str, str]:
        return {m.ticker: m.name for m in self.members}

    def subset(self, tickers: list[str]) -> Universe:
        """The named members in the basket's order, all else as it is."""
        return replace(self, members=tuple(m for m in self.members if m.ticker in set(tickers)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.key, k, m.ticker, m.name, m.group) for k, m in enumerate(self.members)], "universe string, ord int, asset string, name string, grp string")


def _members(roster: dict[str, list[str]]) -> tuple[Member, ...]:
    return tuple(Member(*line.split(" ", 1), group) for group, lines in roster.items() for line in lines)


SURVIVORS = "The members are those that exist today; what failed before is missing."
_ALL = (
    Universe("core_equity", "US large caps by sector", _members(CORE_EQUITY), "Sector", caveats=SURVIVORS),
    Universe("cross_asset", "Funds of several asset classes", _members(CROSS_ASSET), "Asset class", caveats="The youngest funds began in 2007."),
    Universe("crypto_majors", "Liquid coins in US dollars", _members(CRYPTO_MAJORS), "Sector (prior)", "crypto", 1, SURVIVORS),
    Universe("sector_etfs", "One fund per sector", _members(SECTOR_ETFS), "Sector", caveats="Two of the funds began in 2015 and 2018."),
)
UNIVERSES = {u.key: u for u in _ALL}
UNIVERSES["crypto_core"] = replace(UNIVERSES["crypto_majors"].subset(CRYPTO_CORE), key="crypto_core", title="Coins with a long history")
DEFAULT = "core_equity"


def get(key: str) -> Universe:
    if key not in UNIVERSES:
        raise KeyError(f"unknown universe {key!r}; known: {', '.join(sorted(UNIVERSES))}")
    return UNIVERSES[key]


def all_tickers() -> list[str]:
    return list(dict.fromkeys(t for u in UNIVERSES.values() for t in u.tickers))


def resolve(universe: str | None = None, tickers: list[str] | None = None) -> Universe:
    """The universe; explicit tickers replace its roster and keep all else."""
    if universe is None and tickers is None:
        raise ValueError("name a universe or tickers")
    base = get(universe) if universe else Universe("custom", "Named tickers", (), "Group")
    if tickers is None:
        return base
    known = {m.ticker: m for u in UNIVERSES.values() for m in u.members}
    return replace(base, members=tuple(known.get(t, Member(t, t, "Other")) for t in tickers))


def events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(e.split(" ", 1)) for e in EVENTS], "date string, label string").selectExpr("cast(date as date) as date", "label")
