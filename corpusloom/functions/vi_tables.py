"""Word tables of the Vietnamese normalizer, as text: one entry a line, written form and reading."""

from __future__ import annotations


def _table(text: str) -> dict[str, str]:
    return dict(line.strip().split(" ", 1) for line in text.strip().splitlines())


# Readings of units, by their written form in lower case.
UNITS = _table(
    """
    ampe am be
    atm át mót phe
    bq bét cơ ren
    cal ca lo
    carat ca ra
    cc xen ti mét khối
    cd can đê la
    chỉ chỉ
    cm xen ti mét
    công công
    db đề xi ben
    dm đề xi mét
    dp đi ốp
    ev e lét tron vôn
    ft phuốt
    g gam
    gal ga lon
    gallon ga lon
    gb ghi ga bay
    giây giây
    giờ giờ
    h giờ
    ha héc ta
    hz héc
    inch in
    iu đơn vị quốc tế
    j giun
    kb ki lô bay
    kcal ki lô ca lo
    kg ki lô gam
    km ki lô mét
    km/h ki lô mét một giờ
    km/s ki lô mét một giây
    kw ki lô oát
    kwh ki lô oát giờ
    l lít
    lít lít
    lượng lượng
    m mét
    mah mi li am pe giờ
    mb mê ga bay
    mcg micrôgam
    mev mê ga e lét tron vôn
    mg mi li gam
    min phút
    ml mi li lít
    mm mi li mét
    mmhg mi li mét thủy ngân
    mmol mi li mon
    mol mon
    mph dặm một giờ
    mét mét
    mẫu mẫu
    n Niu tơn
    ng nanogam
    ngày ngày
    nm na nô mét
    năm năm
    ohm ôm
    ounce ao
    oz ao
    pa bát can
    ph phút
    pound bao
    rad ra đi an
    radian ra đi an
    s giây
    sec giây
    sào sào
    tháng tháng
    tạ tạ
    tấn tấn
    v vôn
    vnd việt nam đồng
    vnđ việt nam đồng
    vòng vòng
    w oát
    wb ve bê
    wh oát giờ
    yến yến
    °c độ xê
    °f độ ép
    °k độ kê vin
    ℃ độ xê
    ℉ độ ép
    µg micrôgam
    đ đồng
    điôp đi ốp
    đồng đồng
    độ độ
    ω ôm
    """
)
# SI prefixes that compose with a unit symbol, and the symbols they compose with.
PREFIXES = {"d": "đề xi", "c": "xăng ti", "m": "mi li", "μ": "mi cờ rô", "n": "na nô", "p": "pi cô", "k": "ki lô", "h": "héc tô"}
PREFIXED = frozenset("m g l s w v j n hz pa bq ev wh wb mol cal".split())
# Readings of currency signs and of other symbols.
CURRENCY = {"$": "đô la", "%": "phần trăm", "£": "bảng", "¥": "yên", "Ω": "ôm", "฿": "bạc", "₩": "won", "€": "ê rô", "₭": "kíp", "₱": "bê xô"}
SYMBOLS = _table(
    """
    & và
    * sao
    + cộng
    / trên
    < nhỏ hơn
    = bằng
    > lớn hơn
    @ a còng
    \\ xuyệt
    ^ mũ
    © bản quyền
    ¬ phủ định
    ± cộng trừ
    × nhân
    ÷ chia
    α an pha
    β bê ta
    γ ga ma
    δ đen ta
    ε ép si lon
    ζ de ta
    η ê ta
    θ thê ta
    κ cáp ba
    λ lam đa
    μ muy
    ξ xi xi
    π pi
    ρ ro
    σ xích ma
    τ tao
    φ phi
    χ chi
    ψ si
    ω ô me ga
    ‰ phần nghìn
    ℃ độ xê
    ℉ độ ép
    ∀ với mọi
    ∏ tích
    ∑ tổng
    ∞ vô cùng
    ∩ giao
    ∪ hội
    ≈ tương đương
    ≠ khác
    ≤ nhỏ hơn hoặc bằng
    ≥ lớn hơn hoặc bằng
    """
)
# Names of the letters.
LETTERS = _table(
    """
    a a
    ă á
    â ớ
    b bê
    c xê
    d dê
    đ đê
    e e
    ê ê
    f ép
    g giê
    h hát
    i i
    j giây
    k ca
    l lờ
    m mờ
    n nờ
    o o
    ô ô
    ơ ơ
    p pê
    q quy
    r rờ
    s ét
    t tê
    u u
    ư ư
    v vê
    w vê kép
    x ích
    y i
    z giét
    """
)
SHORTHAND = _table(
    """
    bít biết
    bùl buồn
    byt buýt
    dc được
    hok không
    hot hót
    j gì
    k không
    ko không
    mik mình
    mk mình
    net nét
    nhìu nhiều
    oxi ô xi
    thui thôi
    thík thích
    trc trước
    vs với
    wen quen
    wá quá
    đc được
    """
)
ACRONYMS = _table(
    """
    bhxh bảo hiểm xã hội
    bhyt bảo hiểm y tế
    ch cửa hàng
    cmnd chứng minh nhân dân
    hđnd hội đồng nhân dân
    kh khách hàng
    ntn như thế nào
    nv nhân viên
    qtv quản trị viên
    sp sản phẩm
    tgdt thế giới di động
    tgdđ thế giới di động
    tggd thế giới di động
    tphcm thành phố Hồ Chí Minh
    ttbh trung tâm bảo hành
    ttdd trung tâm di động
    tv ti vi
    ubnd ủy ban nhân dân
    vn việt nam
    đt điện thoại
    """
)
# Acronyms of two or three letters that are read in upper case (others collide with English ones), and in lower case.
SHORT_ACRONYMS = frozenset("vn tp đt nv sp ch kh hn ntn".split())
LOWER_ACRONYMS = frozenset("đt tgdđ ntn qtv".split())
# Administrative divisions and other abbreviations that a point may follow.
DIVISIONS = {"kp": "khu phố", "q": "quận", "p": "phường", "h": "huyện", "tx": "thị xã", "tp": "thành phố", "x": "xã"}
TITLES = {"PGS": "phó giáo sư", "GS": "giáo sư", "ThS": "thạc sĩ", "TS": "tiến sĩ", "BS": "bác sĩ"}
PLAIN_WORDS = {"HN": "Hà Nội", "UBND": "ủy ban nhân dân", "VN": "Việt Nam", "vs": "với", "USD": "đô la Mỹ", "VNĐ": "đồng", "VND": "đồng", "đ": "đồng"}

# The words before (or behind) a number that decide how it is read.
RANGE_CUES = frozenset("từ ngày".split())
DAY_CUES = frozenset("ngày sáng trưa chiều tối đêm hôm mùng mồng lúc từ đến".split())
DATE_TOPICS = ("thời gian", "thời hạn", "thời điểm", "hạn", "ngày", "lịch", "diễn ra", "khai mạc", "kéo dài", "dự kiến", "áp dụng", "từ")
HOUR_CUES = frozenset("lúc khoảng từ đến hồi tầm trước sau".split())
DAY_PARTS = frozenset("sáng trưa chiều tối đêm khuya".split())
SCORE_CUES = ("tỉ số", "tỷ số", "đội hình", "thắng", "hòa", "hoà")
ORDINAL_CUES = frozenset("thứ lần kỷ kỉ kì kỳ khóa khoá quý chương phần mục hạng đợt".split())
CODE_CUES = ("mã số", "mã", "số thẻ", "số tài khoản", "số hiệu", "số seri", "serial", "số hồ sơ", "biển số", "hộ chiếu")
CODE_ACRONYMS = frozenset("CMND CCCD BHYT BHXH MST STK IMEI PIN OTP".split())
STREET_CUES = (
    "đường", "số nhà", "số", "nhà", "địa chỉ", "tọa lạc", "cư xá", "đơn vị", "xã", "thôn", "ấp", "khu phố", "căn hộ", "lô", "ngõ", "ngách", "hẻm", "phòng", "lớp",
    "quốc lộ", "tỉnh lộ",
)
COUNTED = frozenset("người dân đồng usd vnd đ lượt cái con chiếc tấn kg mét ha ngày năm giờ lần tỷ triệu nghìn".split())
PRICE_CUES = ("giá", "dân số", "doanh thu", "tổng", "khoảng", "hơn", "gần", "đạt", "lên tới", "thu", "chi", "lãi", "lỗ", "vốn", "mất", "còn", "bán", "mua", "trị giá")
VERSION_CUES = frozenset("ios macos android windows usb hdmi bluetooth wifi wi-fi nokia galaxy iphone ipad chrome java python miui vos version ver bản v".split())
NETWORK_CUES = frozenset("mạng sim sóng gói wifi data".split())
