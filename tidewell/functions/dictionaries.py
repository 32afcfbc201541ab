"""Fixed values that results depend on, in natural order."""

from __future__ import annotations

BOARD_PARTNERS = (
    "ZOTAC", "ASUS", "MSI", "GIGABYTE", "GALAX", "PALIT", "PNY", "COLORFUL", "INNO3D", "GAINWARD", "SAPPHIRE", "XFX", "ASROCK",
)
KEYWORDS = ("RTX", "GTX", "RX", "RADEON", "GEFORCE", "ARC")
MALL_CODES = {
    "SSG": "SSG", "신세계몰": "SSG", "쓱닷컴": "SSG", "ELEVENST": "ELEVENST", "11번가": "ELEVENST", "COUPANG": "COUPANG",
    "쿠팡": "COUPANG", "GMARKET": "GMARKET", "G마켓": "GMARKET", "AUCTION": "AUCTION", "옥션": "AUCTION",
}
TRACKING_KEYS = ("click", "tlidSrchWd", "srchPgNo", "taste", "advertBidId", "siteNo", "salestrNo")
VARIANTS = ("SOLIDCORE", "WINDFORCE", "GAMINGOC", "SUPER")
MAX_PRICE = 100_000_000

NEVER_RETRY = (400, 401, 403, 404)
ALWAYS_RETRY = (408, 429, 500, 502, 503, 504)
BACKOFF_SECONDS = (1.0, 2.0, 4.0)

# Documented only; rows of (text, code).
BRAND_ALIASES = {"ASUSTEK": "ASUS", "ASUSTEK COMPUTER": "ASUS", "MICRO-STAR": "MSI", "기가바이트": "GIGABYTE", "조텍": "ZOTAC"}
STOCK_STATES = {
    "재고있음": "IN_STOCK", "판매중": "IN_STOCK", "in stock": "IN_STOCK", "품절": "OUT_OF_STOCK", "일시품절": "OUT_OF_STOCK",
    "out of stock": "OUT_OF_STOCK", "예약판매": "PREORDER", "preorder": "PREORDER", "단종": "DISCONTINUED", "discontinued": "DISCONTINUED",
}
CONDITIONS = {"신품": "NEW", "new": "NEW", "중고": "USED", "used": "USED", "리퍼": "REFURBISHED", "refurbished": "REFURBISHED", "개봉": "OPEN_BOX", "open box": "OPEN_BOX"}
IMPORTS = {"정품": "OFFICIAL", "official": "OFFICIAL", "병행수입": "PARALLEL_IMPORT", "parallel": "PARALLEL_IMPORT"}
CONFIDENCE = {"official": "HIGH", "large_mall": "HIGH", "seller": "MEDIUM", "marketplace": "MEDIUM"}
NOT_CARDS = ("노트북", "LAPTOP", "NOTEBOOK", "케이블", "CABLE", "장식", "게임", "호환")  # beside the keyword: laptops, cables, ornaments, games, fitting parts
