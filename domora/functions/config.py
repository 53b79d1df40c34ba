"""Fixed values of the listing domain: types, ranges, areas, keywords and feature lists."""

# Residential property types.
RESIDENTIAL_TYPES = ["Nhà riêng", "Nhà mặt tiền", "Căn hộ chung cư", "Biệt thự liền kề", "Nhà biệt thự"]

# Named districts by keyword, in matching order.
NAMED_AREAS = {
    "bình tân": "Quận Bình Tân",
    "bình thạnh": "Quận Bình Thạnh",
    "gò vấp": "Quận Gò Vấp",
    "phú nhuận": "Quận Phú Nhuận",
    "tân bình": "Quận Tân Bình",
    "tân phú": "Quận Tân Phú",
    "bình chánh": "Huyện Bình Chánh",
    "cần giờ": "Huyện Cần Giờ",
    "củ chi": "Huyện Củ Chi",
    "hóc môn": "Huyện Hóc Môn",
    "nhà bè": "Huyện Nhà Bè",
}
MERGED_AREA = (["quận 2", "quận 9", "thủ đức"], "TP. Thủ Đức")
UNKNOWN_AREA, UNKNOWN_VALUE = "Unknown", "Không rõ"

# Inclusive ranges of optional numbers; price and area have an open upper end.
PRICE_RANGE, AREA_RANGE, MIN_UNIT_PRICE = (100.0, 50_000.0), (5.0, 500.0), 10.0
OPTIONAL_RANGES = {"bedrooms": (1, 10), "bathrooms": (0, 20), "floors": (0, 100), "width": (0.1, 100.0), "length": (0.1, 200.0), "alley_width": (0.0, 30.0)}
LATITUDE_RANGE, LONGITUDE_RANGE = (10.3, 11.2), (106.3, 107.0)
CENTRE = (10.7769, 106.7009)

# Keyword flags and the negation before a keyword.
KEYWORDS = {
    "has_furniture": ["nội thất", "full nội thất"],
    "car_alley": ["hẻm xe hơi", "hẻm ô tô", "hẻm oto", "ô tô vào", "oto vào", "hxh"],
    "near_market": ["gần chợ", "sát chợ"],
    "near_school": ["gần trường", "đại học", "trường học"],
    "is_urgent_sale": ["cần bán gấp", "bán gấp", "chính chủ"],
}
NEGATORS = ["không", "chưa", "chẳng", "ko", "chua", "khong"]
NEGATION = rf"(?:{'|'.join(NEGATORS)})\s+(?:có\s+|được\s+)?"

# Model features in order (snake case of the headings).
NUMERIC_FEATURES = [
    "area", "bedrooms", "bathrooms", "floors", "width", "length", "alley_width", "latitude", "longitude",
    "distance_to_cbd_km", "days_from_train_reference", "input_completeness_score",
]
CATEGORICAL_FEATURES = ["property_type", "location_area", "direction", "position"]
FLAG_FEATURES = list(KEYWORDS)
MISSING_FEATURES = ["gps_missing", "width_missing", "length_missing", "bedrooms_missing", "bathrooms_missing", "floors_missing", "road_type_missing", "alley_width_missing"]
MODEL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES + FLAG_FEATURES + MISSING_FEATURES
# Columns whose presence makes an input complete.
QUALITY_COLUMNS = ["bedrooms", "bathrooms", "floors", "width", "length", "alley_width", "direction", "position", "latitude", "longitude"]
# Split shares and the target coverage of intervals.
SPLIT_SHARES = (0.60, 0.15, 0.10, 0.15)
COVERAGE = 0.8
