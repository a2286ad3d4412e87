"""Word lists, lookup tables, patterns and thresholds.

These values decide results, so they are kept together and stated plainly. Each block names the text
its patterns are matched against: raw text (case ignored), ``fold_marks`` (lower case, no accents,
d-bar kept) or ``fold`` (the same with d-bar as d).
"""

from __future__ import annotations

# --- fixed values: enumerations ------------------------------------------------------------------
CATEGORIES = [
    "Food", "Transport", "Housing", "Essentials", "Shopping", "Beauty",
    "Health", "Education", "Entertainment", "Social", "Salary", "Bonus",
    "Business", "Investment", "Debt", "Charity", "Savings", "Others",
]
RECEIPT_CATEGORIES = [
    "Food", "Essentials", "Social", "Transport", "Shopping", "Housing",
    "Health", "Beauty", "Education", "Entertainment", "Investment", "Others",
]
INCOME_LABELS = ["Salary", "Bonus", "Business", "Investment", "Savings", "Saving"]
RECORD_TYPES = ["expense", "income"]
INTENTS = ["Record", "Action", "Chitchat"]
VERBS = ["SET", "ADD", "SUB"]
THEMES = ["dark", "light"]
VERBAL_STYLES = ["funny", "gentle", "serious", "sarcastic", "strict"]
SLOT_COLUMNS = [
    "verb", "category_code", "value", "goal_name", "enabled",
    "theme", "verbal_style", "time_range", "query", "note",
]
ACTION_COLUMNS = ["text", "intent", "action_type"] + SLOT_COLUMNS
SLOTS_BY_ACTION = {
    "SET_LIMIT": ["verb", "category_code", "value"],
    "SET_ALERT": ["category_code", "enabled"],
    "SET_GOAL": ["goal_name", "value"],
    "ADD_GOAL": ["verb", "goal_name", "value"],
    "SYSTEM_SETTING": ["theme"],
    "SET_TONE": ["verbal_style"],
    "SET_USERNAME": ["value"],
    "SEARCH_RECORD": ["query", "category_code", "value"],
    "REPORT_GENERAL": ["time_range", "category_code"],
    "SUGGEST_BUDGET": ["time_range"],
}
MISSING_CHECK = {
    "REPORT_COMPARE": ["time_range"],
    "SET_LIMIT": ["amount"],
    "SET_GOAL": ["goal_name", "amount", "tool_type"],
    "ADD_GOAL": ["amount"],
    "SET_TONE": ["verbal_style"],
    "SET_ALERT": ["enabled"],
    "SYSTEM_SETTING": ["theme"],
    "SET_USERNAME": ["query"],
}
LOAN_FIELDS = ["contact_name", "loan_type"]
ACTIONS_WITH_CATEGORY = ["REPORT_GENERAL", "REPORT_COMPARE", "SET_LIMIT", "SEARCH_RECORD", "SUGGEST_BUDGET"]
BENCHMARK_ACTIONS = [
    "REPORT_GENERAL", "REPORT_COMPARE", "SET_LIMIT", "SET_GOAL", "ADD_GOAL", "SET_TONE",
    "SEARCH_RECORD", "SUGGEST_BUDGET", "SYSTEM_SETTING", "SET_USERNAME", "SET_ALERT",
]
BENCHMARK_EXPENSE = [
    "Food", "Transport", "Shopping", "Beauty", "Social", "Health", "Housing", "Education",
    "Entertainment", "Essentials", "Business", "Charity", "Debt", "Savings", "Investment", "Others",
]
BENCHMARK_INCOME = ["Salary", "Bonus", "Business", "Others"]
NO_CATEGORY_ACTIONS = ["SET_TONE", "SYSTEM_SETTING", "SET_ALERT", "SET_GOAL", "ADD_GOAL"]
EMPTY_WORDS = ["", "nan", "none"]
INTENT_ALIASES = {
    "record": "Record", "log_expense": "Record", "log expense": "Record",
    "log transaction": "Record", "log_transaction": "Record", "log": "Record",
    "action": "Action", "system": "Action",
    "chitchat": "Chitchat", "chat": "Chitchat", "chit-chat": "Chitchat",
}
TYPE_ALIASES = {
    "expense": "Expense", "spending": "Expense", "chi": "Expense",
    "income": "Income", "earnings": "Income", "thu": "Income",
}
ACTION_ALIASES = {
    "Report": "REPORT_GENERAL", "REPORT_GENERAL": "REPORT_GENERAL", "REPORT_COMPARE": "REPORT_GENERAL",
    "Search": "SEARCH_RECORD", "SEARCH_RECORD": "SEARCH_RECORD", "Setting": "SYSTEM_SETTING",
}
RETIRED_ACTIONS = ["SET_INCOME", "UPDATE_RECORD", "DELETE_RECORD"]

# --- fixed values: money -------------------------------------------------------------------------
# On lower-case text with accents.
MONEY = r"[0-9]+(?:[.,][0-9]+)?\s?(?:k|đ|d|vnđ|vnd|ngan|nghin|tr|triệu|trieu|củ|cu)"
NUMBER_WORDS = {
    "1": "một|mot", "2": "hai", "3": "ba", "4": "bốn|bon", "5": "năm|nam",
    "6": "sáu|sau", "7": "bảy|bay", "8": "tám|tam", "9": "chín|chin", "10": "mười|muoi",
}
NUMBER_WORD_UNITS = (
    "k|cành|canh|lít|lit|xị|xi|sị|si|loét|loet|củ|cu|quả|qua|mâm|mam|chục|chuc|triệu|trieu|tr|ngàn|ngan|nghìn|nghin"
    "|đ|d|vnd|vnđ"
)
AMOUNT_UNITS = (
    "k|ngan|nghin|tr|trieu|triệu|cu|củ|d|đ|vnd|vnđ|cành|canh|lít|lit|xị|xi|sị|si|loét|loet|quả|qua|mâm|mam|chục|chuc"
)
PLAIN_STOP_UNITS = (
    "k|ngan|nghin|tr|trieu|triệu|cu|củ|cành|canh|lít|lit|xị|xi|sị|si|loét|loet|quả|qua|mâm|mam|chục|chuc"
)
UNIT_VALUES = {
    1_000: ["k", "ngan", "nghin", "cành", "canh"],
    1_000_000: ["tr", "trieu", "triệu", "cu", "củ", "quả", "qua", "mâm", "mam"],
    100_000: ["lít", "lit", "xị", "xi", "sị", "si", "loét", "loet"],
    10_000: ["chục", "chuc"],
}
TYPOS = {"ca pe": "ca phe", "cuc dang": "cuc vang", "cục dàng": "cục vàng"}

# --- fixed values: category text cleaning (lower-case text with accents) -------------------------
CATEGORY_MONEY = r"[0-9]+(?:[.,][0-9]+)?\s?(?:k|đ|d|vnđ|vnd|ngan|nghin|tr|triệu|trieu|củ|cu)"
PAYMENT_WORDS = "vnđ|vnd|banking|momo|zalopay|vnpay|qr|thẻ|the|tiền mặt|cash|chuyển khoản|pos"
RECEIPT_WORDS = (
    "hóa đơn|hoa don|phiếu thanh toán|phieu thanh toan|thanh toán|tổng tiền|tong tien|tổng cộng|tong cong"
    "|thu ngân|thu ngan|tiền thối|tiền thừa|tiền khách|khách cần trả|khách thanh toán|mã số thuế|mst|sđt|hotline"
    "|đơn giá|thành tiền"
)

# --- fixed values: relabelling (fold; ACTION_LIKE and FAMILY_* on fold_marks; ALERT and words raw) -----------------------------------------------------
ACTION_LIKE = (
    r"tong\s+chi|(?:thang|tuan|hom|quy)\s+nay\b.+(?:tieu|chi\b).*(?:bao\s+nhieu|het|may|roi)|tieu\s+bao\s+nhieu"
    r"|da\s+tieu|thong\s+ke\s+chi|chi\s+tieu\s+(?:thang|tuan)"
)
SELL = r"^(?:ban|thu\s+tien\s+tu\s+ban|nhan\s+tien\s+ban)\b"
BUY = r"^(?:mua|order|chi|thanh\s+toan|tra|dong)\b"
REFUND = r"\b(?:hoan|refund|luong|thuong|lai|ck\s+ve|cho\s+[0-9])\b"
GIFT_BUY = r"\bmua\s+qua\s+cho\b"
GADGET = (
    r"\bmua\s+(?:sac|cap|tai\s+nghe|airpods|case|op|chuot|ban\s+phim|webcam|hub|o\s+cung|ao|quan|giay|dep|balo"
    r"|hoodie|sneaker)\b"
)
GROCERY = r"\b(?:gao|mi\s+goi|giay\s+ve\s+sinh|nuoc\s+rua|bot\s+giat)(?:\s|$|[0-9])"
OUTING_CAFE = (
    r"\b(?:di|hen|tu\s+tap|gap|uong|di\s+uong)\s+(?:ca\s+phe|cafe|cf)\b"
    r"|\b(?:ca\s+phe|cafe|cf)\b.*\b(?:voi|ban|be|bo|ny|crush|nguoi\s+yeu)\b"
)
OUTING_OTHER = r"\b(?:bar|pub|club|spa|salon|massage|karaoke|kaoke|bida|phim|cinema|rap|du\s+lich|restaurant|nhau)\b"
COFFEE = r"\b(?:ca\s+phe|cafe|cf)\b"
MEAT = r"\bthit\s+(?:heo|lon|bo|ga|ca|tom)\b"
FAMILY_GIFT = (
    r"(?:gia\s+dinh|gđ|gd)\s+cho\b|(?:me|ma|bo|ba|ong|anh|chi|em|co|chu|di|bac)\s+cho\b"
    r"|(?:ong\s+ba|cha\s+me)\s+cho\b|(?:me|ma|bo|ba|ong)\s+(?:ck|gui)\b|ban\s+cho\b"
)
FAMILY_VETO = r"\bcho\s+xin\b|\bdi\s+choi\b|\bchot\s+keo\b|\bmua\s+.*\s+cho\b"
ALERT_TEXT = (
    r"cảnh\s*báo|canh\s*bao|thông\s*báo|thong\s*bao|nhắc\s*khi\s*chi|nhac\s*khi\s*chi|vượt\s*mức|vuot\s*muc"
    r"|nhắc\s*nhở.*(?:chi\s*tiêu|di[eê]m\s*chi|mục\s*tiêu|muc\s*tieu|thanh\s*toán|thanh\s*toan|đến\s*hạn|den\s*han)"
)
SUGGEST_PHRASES = ["goi y", "gợi ý", "de xuat", "đề xuất"]
SUGGEST_TOPICS = [
    "chi tieu", "chi tiêu", "tiet kiem", "tiết kiệm", "ngan sach", "ngân sách", "han muc", "hạn mức",
]
DELETE_WORDS = ["xóa", "xoa", "bỏ", "bo", "hủy", "huy", "gỡ", "go"]
REPORT_WORDS = [
    "tổng chi", "báo cáo", "thống kê", "chi tiêu tuần", "chi tiêu tháng", "chi tiêu hôm nay",
    "thu nhập tuần", "thu nhập tháng", "thu nhập hôm nay",
]

# --- fixed values: shortening of long notes (text with accents, case ignored) --------------------
STORY_PREFIX = (
    r"^(?:story time\s*[0-9]+\s*:\s*|case văn phòng\s*:\s*|case van phong\s*:\s*|english boi\s*:\s*"
    r"|teencode mode on\s*:\s*|an sang khong dau\s*:\s*|lương thưởng style genz\s*:\s*"
    r"|luong thuong style genz\s*:\s*|boi tien roi ne\s*:\s*|đòi được tiền\s*:\s*|doi duoc tien\s*:\s*"
    r"|cash-in from\s*|gia đình ở\s*|gia dinh o\s*|nhận tiền từ\s+|nhan tien tu\s+)"
)
PLACE_PART = (
    r"\s*(?:ở|o|tai|tại|in|at)\s+(?:food court(?: trung tâm thương mại)?|pantry văn phòng|pantry van phong"
    r"|mall lunch zone|coworking|khu trọ|khu tro|sảnh tòa nhà|sanh toa nha|chung cư|chung cu|nhà ngoại|nha ngoai"
    r"|nhà nội|nha noi|quán cóc|quan coc)"
)
PAY_SUFFIX = (
    r"(?:,?\s*(?:về ví|ve vi|về tk|ve tk)\s*(?:qua|bang|bằng)?\s*(?:scan qr|quẹt thẻ|quet the|tiền mặt|tien mat"
    r"|chuyển khoản|chuyen khoan|banking app)[^,]*"
    r"|,?\s*(?:thanh toán|thanh toan|xử lý|xu ly|tra|trả)\s*(?:bằng|bang|qua)?\s*(?:banking app|scan qr|quẹt thẻ"
    r"|quet the|tiền mặt|tien mat|chuyển khoản)[^,]*"
    r"|,?\s*(?:order trên|order tren|mua trên|mua tren)\s*(?:shopee|lazada|tiki|grab|netflix)[^,]*"
    r"|,?\s*hóa đơn định kỳ[^,]*"
    r"|,?\s*(?:okela|xỉu up xỉu down|xiu up xiu down|vibe ổn|chill|căng phết|flex nhẹ)[^,]*)+$"
)
FILLERS = r"\b(?:tổng|tong|mất|mat|hết|het|chốt|chot|pay|combo|làm|lam|xong)\b"
NOTE_MONEY = r"\+?[0-9]+(?:[.,][0-9]+)?\s?(?:k|tr|triệu|trieu|củ|cu|ngàn|ngan|nghìn|nghin|vnđ|vnd|đ)"
NOTE_VERBS = ["mua", "chi", "order", "thanh toán", "trả", "đóng", "đi", "ăn"]

# --- fixed values: receipts ----------------------------------------------------------------------
# Keyword lexicon, matched as substrings of fold_marks text (spellings with accents could not match it).
CATEGORY_KEYWORDS = {
    "Food": [
        "an uong", "ca phe", "coffee", "cafe", "the coffee", "highlands", "phuc long", "starbucks", "tra ", "tra den",
        "keo", "banh", "snack", "chocolate", "alpenliebe", "dynamite", "duong", "dau ", "mam ", "tuong", "kem ",
        "kem que", "sua ", "bot ", "knorr", "pho", "bun", "com ", "nuoc", "bia ", "do uong", "thap cam",
        "trang tien", "cai lan", "meizan", "tinh luyen", "grabfood", "ship do an",
    ],
    "Essentials": [
        "bobby", "ta ", "giay", "ve sinh", "rau ", "thit", "gao", "di cho", "xa phong", "nuoc giat",
    ],
    "Shopping": [
        "durex", "bao cao su", "bao cao", "dien thoai", "tai nghe", "may tinh", "laptop", "ao ", "giay dep",
    ],
    "Transport": ["xang", "grab bike", "grabbike", "vexere", "ve xe", "gui xe", "bai xe"],
    "Housing": ["dien ", "nuoc ", "internet", "wifi", "thue nha"],
    "Health": ["thuoc", "nha thuoc", "yte"],
    "Beauty": ["my pham", "son ", "kem duong", "dau goi"],
    "Entertainment": ["netflix", "spotify", "youtube", "xem phim", "cgv", "game"],
    "Education": ["hoc phi", "sach", "truong"],
    "Social": ["qua tang", "sinh nhat"],
}
# Raw text.
HEADER_SKIP = r"hoa don|hóa đơn|tel|website|mst|ma so thue|so gd|thu ngan|xin cam"
TOTAL_LINE_SCORES = [
    (100, r"cộng\s*tiền\s*hàng|cộng\s*tien\s*hang"),
    (98, r"tổng\s*tiền\s*phải|phải\s*t\.?\s*toán|phai\s*t\.?\s*toan"),
    (96, r"tiền\s*thanh\s*toán|tien\s*thanh\s*toan"),
    (95, r"tổng\s*cộng|tong\s*cong"),
    (92, r"thành\s*tiền|thanh\s*tien|t\.?\s*ti[eê]n\b"),
    (88, r"tổng\s*tiền|tong\s*tien"),
    (80, r"tiền\s*khách\s*trả|tien\s*khach\s*tra"),
    (70, r"thanh\s*toán|thanh\s*toan"),
]
SKIP_LINE = r"đơn\s*giá|don\s*gia|mã\s*sp|barcode|số\s*gd|so\s*gd|mst|mã\s*số\s*thuế"
TABLE_HEADER = r"mat\s*hang|mặt\s*hàng|don\s*gia|đơn\s*giá|\bsl\b|t\.?\s*tien|thanh\s*tien|ttien"
DOCUMENT_NUMBER = r"số\s*h[dđ]|so\s*h[dđ]|số\s*gd|so\s*gd"
# fold_marks text.
CHANGE_LINE = "tien tra lai"
DISCOUNT_LINE = r"da\s*giam|giam\s*gia|chiet\s*khau"
AMOUNT_TOKEN = r"(?<![0-9.,])([0-9]{1,3}(?:[.,][0-9]{3})+|[0-9]{4,9})(?![0-9.,])"
BRANDS = [
    ("Food", r"highlands|phuc\s*long|starbucks|the\s*coffee|ca\s*phe|coffee\s*house|gong\s*cha|mixue|katinat"
             r"|phuc\s*loc\s*tho|kfc|mcdonald|jollibee|lotteria|pizza|quan\s*an|nha\s*hang|tra\s*sua"),
    ("Health", r"pharmacity|long\s*chau|guardian|medicare|phano|an\s*khang|nha\s*thuoc"),
    ("Shopping", r"zara|uniqlo|hm\b|mango\b|canifa|thoi\s*trang|quan\s*ao"),
    ("Food", r"circle\s*k|gs25|family\s*mart|ministop|7\s*-\s*eleven|7\s*eleven"),
    ("Essentials", r"winmart|vinmart|co\.?\s*op|coopmart|lotte|bach\s*hoa|aeon|big\s*c|sieu\s*thi"),
    ("Transport", r"grab|gojek|xanh\s*sm|taxi|mai\s*linh|vinasun|petrolimex|xang\s*dau"),
]
KIE_TOTAL = (
    r"tong\s*thanh\s*toan|tien\s*thanh\s*toan|thuc\s*thu|thuc\s*tra|phai\s*thanh\s*toan|tong\s*cong|thanh\s*tien"
    r"|tong\s*tien|total"
)
KIE_TOTAL_LABEL = KIE_TOTAL + r"|phai\s*t\.?\s*toan|t\.?\s*tien\b"
KIE_ADDRESS = r"duong|phuong|quan|tp\.|thanh\s*pho|so\s*[0-9]"
KIE_TIMESTAMP = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{1,2}:[0-9]{2}"
KIE_EXCLUDE = (
    r"tien\s*mat|khach\s*dua|tien\s*khach|cash|received|tra\s*lai|tien\s*thua|thoi\s*lai|change"
)
KIE_DISCOUNT = r"da\s*giam|giam\s*gia|discount|chiet\s*khau|km\s*giam"
# Raw lower-case text.
DATE_WORDS = r"ngay|thang|nam|date|time|gio|phut|giờ|phút|ngày|tháng|năm"
UNIT_WORDS = ["hộp", "gói", "sữa", "chai", "lon", "cái", "thịt", "cá", "rau", "vnd", "vnd:", "đ", "d"]
ROW_TOTAL = KIE_TOTAL + r"|cong|cộng"
ROW_EXCLUDE = (
    KIE_EXCLUDE + r"|thoi|tra|chuyen\s*khoan|visa|mastercard|atm|momo|vnpay|zalopay|thanh\s*toan\s*qua|tien\s*the|ck"
)
ROW_DISCOUNT = r"da\s*giam|đã\s*giảm|giam\s*gia|giảm\s*giá|discount|chiet\s*khau|chiết\s*khấu|km"
MERCHANTS = [
    ("WinMart", r"winmart|vinmart|win\s*\+"), ("Grab", r"grab"), ("Circle K", r"circle\s*k"),
    ("Phúc Long", r"phuc\s*long|phúc\s*long"), ("Highlands Coffee", r"highlands"), ("Starbucks", r"starbucks"),
    ("Lotte Mart", r"lotte"), ("Aeon Mall", r"aeon"), ("KFC", r"kfc"), ("McDonald's", r"mcdonald"),
    ("Jollibee", r"jollibee"), ("Phano Pharmacy", r"phano"), ("Nhà Thuốc An Khang", r"an\s*khang"),
    ("Pharmacity", r"pharmacity"),
    ("Co.opmart", r"co\.?op\s*smart|coop\s*smart|coop\s*mart|co\.?op\s*mart"),
    ("Bách Hóa Xanh", r"bach\s*hoa\s*xanh|bách\s*hóa\s*xanh"), ("Gong Cha", r"gong\s*cha"),
    ("The Coffee House", r"the\s*coffee\s*house"), ("Mixue", r"mixue"), ("Katinat", r"katinat"),
    ("Phúc Lộc Thọ", r"phuc\s*loc\s*tho|phúc\s*lộc\s*thọ"), ("GS25", r"gs25"), ("FamilyMart", r"family\s*mart"),
    ("7-Eleven", r"7\s*-\s*eleven|7\s*eleven"), ("MiniStop", r"ministop|mini\s*stop"),
]
MERCHANT_SKIP = (
    r"hoa don|hóa đơn|phiếu|phieu|mst|tel|phone|ngày|ngay|date|thu ngân|thu ngan|địa chỉ|dia chi|address"
)
LABEL_TYPOS = {"TIMESTAMPS": "TIMESTAMP", "TOTAL_TOTAL_COST": "TOTAL_COST"}
ENTITIES = ["SELLER", "ADDRESS", "TIMESTAMP", "TOTAL_COST"]
ENTITY_TAGS = [
    "B-ADDRESS", "B-SELLER", "B-TIMESTAMP", "B-TOTAL_COST",
    "I-ADDRESS", "I-SELLER", "I-TIMESTAMP", "I-TOTAL_COST", "O",
]
LABEL_TIME_WORDS = ["ngày", "thời gian", "giờ"]
LABEL_TOTAL_WORDS = ["tổng tiền", "cộng tiền hàng", "tổng cộng", "thanh toán", "tại quầy"]
MART_WORDS = ["sieu thi", "bach hoa", "vinmart", "mart"]

# --- fixed values: chat --------------------------------------------------------------------------
PARENT_WORDS = (
    "cha|mẹ|me|ba|má|bố|ông|bà|anh hai|chị hai|anh ba|chị ba|ông bô|bà bô|ông nội|bà nội|ông ngoại|bà ngoại|mom"
    "|mommy|momy|má mỳ|dad|daddy|dady|cậu|mợ|dì|chú|thím|bác"
)
PARTNER_WORDS = (
    "người yêu|bồ|vợ|chồng|gấu|crush|ny|cr|vk|ck|bã xã|bà xã|ông xã|iu|babe|baby|người thương|nửa kia"
)
SPEND_WORDS = "mua|tặng|chuyển|trả|bao|đãi|đưa|chi|tiêu|mời"
POSITIVE_WORDS = ["cam on", "thanks", "vui", "hihi", "haha", "thich", "hay qua", "ngon mieng", "tot ", "yeu "]
NEGATIVE_WORDS = ["buon", "met ", "met qua", "chan ", "that vong", "stress", "that buon"]
PERSONAS = {
    "vui": "Happy", "hai_huoc": "Happy", "dan_doi": "Angry", "dong_cam": "Love",
    "nghiem_tuc": "Thinking", "cham_choc": "Taunting",
}
ASSETS = [
    "Alert", "Angry", "Approved", "Celebrate", "Chill", "Cooking", "Cool", "Determined", "Error", "Excited",
    "Giggle", "Happy", "Hello", "Loading", "Love", "Proud", "Relax", "Sad", "Sleepy", "Sassy", "Shopping", "Travel",
    "Sorry", "Success", "Taunting", "Thankful", "Thinking", "Working", "Worried",
]
REPLY_DEFAULT = "Mimo đã ghi nhận rồi nha!"
CATEGORY_ALIASES = {
    "ăn uống": "Food", "cà phê": "Food", "mua sắm": "Shopping",
    "đi chợ": "Essentials", "giải trí": "Entertainment", "linh tinh": "Others",
}

# --- fixed values: rule baseline -----------------------------------------------------------------
# Spellings are folded with fold_marks before use; a word listed with and without accents counts twice.
BASELINE_KEYWORDS = {
    "Food": [
        "an ", "ăn", "phở", "pho", "bun", "bún", "com", "cơm", "trà sữa", "tra sua", "cafe", "cà phê", "ca phe",
        "highlands", "phuc long", "starbucks", "grabfood", "ship đồ ăn", "ship do an", "banh", "bánh", "kem", "sữa",
    ],
    "Shopping": [
        "ao", "áo", "quan", "quần", "giày", "giay", "tui xach", "túi xách", "điện thoại", "dien thoai", "laptop",
        "tai nghe", "shopee", "lazada", "tiki",
    ],
    "Essentials": [
        "rau", "thịt", "thit", "gạo", "gao", "đi chợ", "di cho", "siêu thị", "sieu thi", "vinmart", "bach hoa",
        "bách hóa", "giấy vệ sinh", "giay ve sinh", "xà phòng", "nước giặt",
    ],
    "Transport": [
        "xăng", "xang", "grab bike", "grabbike", "grab car", "be ", "be xe", "taxi", "xe ôm", "xe om", "vé xe",
        "ve xe", "gửi xe", "gui xe",
    ],
    "Housing": [
        "tiền điện", "tien dien", "tiền nước", "tien nuoc", "internet", "wifi", "thuê nhà", "thue nha", "tiền nhà",
    ],
    "Health": [
        "thuốc", "thuoc", "khám bệnh", "kham benh", "bệnh viện", "benh vien", "nha thuoc", "nhà thuốc", "y tế",
    ],
    "Beauty": ["mỹ phẩm", "my pham", "son môi", "kem dưỡng", "dầu gội"],
    "Entertainment": ["netflix", "spotify", "xem phim", "cgv", "game", "youtube premium"],
    "Education": ["học phí", "hoc phi", "sách", "sach", "khóa học", "khoa hoc"],
    "Social": ["quà", "qua tang", "sinh nhật", "sinh nhat", "đám cưới", "dam cuoi"],
}
BASELINE_INCOME = [
    "lương", "luong", "thưởng", "thuong", "được cho", "duoc cho", "mẹ cho", "me cho", "ba cho", "bố cho", "bo cho",
    "tiền bán", "tien ban", "thu nhập", "thu nhap", "freelance", "nhận tiền", "nhan tien",
]
BASELINE_ACTION = [
    "đặt", "dat", "thiết lập", "thiet lap", "đổi", "doi", "báo cáo", "bao cao", "tổng chi", "tong chi", "thống kê",
    "thong ke", "xem chi tiêu", "tổng thu", "tong thu", "thu nhập", "thu nhap", "tổng tiền gửi", "tong tien gui",
    "tổng tiền rút", "tong tien rut", "tiền gửi", "tien gui", "tiền rút", "tien rut",
]

# --- fixed values: generation --------------------------------------------------------------------
# Raw lower-case text.
TOPIC_LABELS = [
    ("Food", ["thịt", "phở", "bún", "cơm", "bánh", "trà", "sữa", "mì", "gạo", "cá", "tôm", "trứng", "chuối", "cam"]),
    ("Transport", ["grab", "xăng", "xe", "bus"]),
    ("Housing", ["điện", "nước", "wifi", "internet", "4g", "data"]),
    ("Shopping", ["shopee", "lazada", "tiktok", "tiki", "sạc", "chuột", "bàn phím", "áo", "quần", "giày", "balo", "túi"]),
    ("Beauty", ["son", "serum", "kem", "mỹ phẩm", "make up", "nails", "tóc", "cắt tóc"]),
    ("Health", ["thuốc", "khám"]),
    ("Education", ["học", "sách", "photocopy"]),
    ("Entertainment", ["phim", "netflix", "spotify", "game", "du lịch", "cafe", "bar", "pub", "club", "spa", "massage",
                       "bida", "karaoke"]),
    ("Social", ["quà", "sinh nhật"]),
    ("Essentials", ["dầu gội", "giấy", "bột giặt", "nước rửa", "muối", "đường", "tỏi", "gas", "gạo"]),
    ("Housing", ["máy giặt", "tủ", "kệ", "đèn", "giặt"]),
]
SHORT_NAME_FILLERS = ["nguyên", "dinh", "ít", "không", "loại", "truyền", "cao", "trẻ"]
PRICES = [
    "10k", "15k", "18k", "20k", "25k", "28k", "30k", "32k", "35k", "38k", "40k", "45k", "50k", "60k", "70k", "80k",
    "90k", "100k", "120k", "150k", "180k", "200k", "250k", "300k", "500k", "1tr", "1.5tr", "2tr",
]
BALANCE_AMOUNTS = [
    "25k", "50k", "88k", "120k", "200k", "350k", "500k", "1tr", "1.5tr", "2tr", "2.5tr", "3tr",
]
COMPANIONS = [
    "ba mẹ", "mẹ", "bố", "cha mẹ", "ông bà", "anh trai", "chị gái", "em út", "con", "bé", "người yêu", "bồ",
    "bạn gái", "bạn trai", "bạn thân", "đồng nghiệp", "sếp",
]
FOOD_TEMPLATES = [
    "mua {t} {m}", "ăn {t} {m}", "uống {t} {m}", "order {t} {m}", "thanh toán {t} {m}", "mua {t} cho {c} {m}",
    "ăn {t} cùng {c} {m}", "uống {t} cùng {c} {m}",
]
GOODS_TEMPLATES = [
    "mua {t} {m}", "thanh toán {t} {m}", "mua {t} cho {c} {m}", "mua giùm {c} {t} {m}", "mua thêm {t} {m}",
    "chi tiền mua {t} {m}",
]
EXPENSE_TEMPLATES = [
    "{t} {m}", "{m} cho {t}", "{t} hết {m}", "{t},{m}", "mua {t} {m}", "chi {t} {m}", "order {t} {m}",
    "trả {t} {m}", "đi {t} {m}", "{t} {m} nha", "{t} tầm {m}", "vừa {t} {m}", "{t} ~{m}", "spend {t} {m}",
]
PLACE_TEMPLATES = ["mua {t} ở {p} {m}", "{t} {p} {m}", "order {t} {p} {m}", "{p}: {t} {m}", "quẹt {p} {t} {m}"]
SHORT_PLACES = ["Grab", "GF", "ShopeeFood", "st", "chợ", "BHX", "Coopmart", "Tiki", "Lazada", "quán", "tiktok shop", "Momo"]
INCOME_TEMPLATES = [
    ("lg {m}", "Salary"), ("lương {m}", "Salary"), ("lương về {m}", "Salary"), ("nhận lương {m}", "Salary"), ("thg {m}", "Bonus"),
    ("thưởng {m}", "Bonus"), ("lì xì {m}", "Bonus"), ("{m} về tk", "Salary"), ("ck về {m}", "Business"), ("mẹ ck {m}", "Bonus"),
    ("me cho {m}", "Bonus"), ("mẹ cho {m}", "Bonus"), ("gia đình cho {m}", "Bonus"), ("nhận {m}", "Business"), ("hoàn {m}", "Business"),
    ("refund {m}", "Business"), ("được hoàn {m}", "Business"), ("fl nhận {m}", "Business"), ("cổ tức {m}", "Investment"),
    ("lãi tk {m}", "Investment"), ("lãi {m}", "Investment"), ("tip {m}", "Business"), ("bán đồ cũ {m}", "Business"),
]
SHORT_TEMPLATES = [
    ("đi grab {m}", "Transport"), ("bắt grab {m}", "Transport"), ("book grab {m}", "Transport"), ("grab {m}", "Transport"), ("grb {m}", "Transport"),
    ("ăn sáng {m}", "Food"), ("an sang {m}", "Food"), ("cf đen {m}", "Food"), ("cf sữa {m}", "Food"), ("cà phê sửa {m}", "Food"), ("ts {m}", "Food"),
    ("phở {m}", "Food"), ("ăn vặt {m}", "Food"), ("điện {m}", "Housing"), ("net {m}", "Housing"), ("4g {m}", "Housing"), ("xăng {m}", "Transport"),
]
ABBREVIATIONS = {
    "grab": ["grab", "grb", "di grab", "bắt grab", "book grab", "cuốc grab"],
    "trà sữa": ["ts", "tra sua", "trà sữa"],
    "cà phê": ["cf", "ca phe", "cafe", "cà phê"],
    "phở": ["phở", "pho"],
    "hủ tiếu": ["hủ tiếu", "hu tieu", "ht"],
    "ăn sáng": ["ăn sáng", "an sang", "bk sáng"],
    "ăn vặt": ["ăn vặt", "an vat", "snack"],
    "siêu thị": ["st", "siêu thị", "sieu thi"],
    "shopee": ["shopee", "shoppe", "spx"],
    "tiền điện": ["điện", "tien dien", "evn"],
    "tiền nước": ["nước", "tien nuoc"],
    "xăng": ["xăng", "xang", "đổ xăng"],
}
SHORT_TOPIC_LABELS = [
    ("grab", "Transport"), ("xăng", "Transport"), ("grabfood", "Food"), ("grab bike", "Transport"), ("tiền điện", "Housing"), ("tiền nước", "Housing"),
    ("tiền internet", "Housing"), ("tiền wifi", "Housing"), ("tiền wif", "Housing"), ("tiền data", "Housing"), ("tiền 4g", "Housing"), ("gas", "Housing"),
    ("netflix", "Entertainment"), ("spotify", "Entertainment"), ("xem phim", "Entertainment"), ("shopee", "Shopping"), ("shoppe", "Shopping"),
    ("lazada", "Shopping"), ("tiktok", "Shopping"), ("spa", "Beauty"), ("nail", "Beauty"), ("cắt tóc", "Beauty"), ("mỹ phẩm", "Beauty"),
    ("mua thuốc", "Health"), ("học phí", "Education"),
]
SHORT_FOOD_WORDS = [
    "ăn", "phở", "bún", "cơm", "mì", "bánh", "trà", "sữa", "thịt", "cá", "tôm", "trứng", "chuối", "cam", "gạo", "vặt", "nui", "chả", "xoài", "ổi",
]
SHORT_FOOD_TOPICS = ["cà phê", "hủ tiếu"]
SHORT_BEAUTY = ["spa", "nail", "tóc", "kem", "son", "mặt nạ"]
BUDGET_CORES = [
    "gợi ý chi tiêu", "gợi ý tiết kiệm", "goi y chi tieu tuan nay", "đề xuất ngân sách tuần này",
]
BUDGET_SUFFIXES = ["", " nha", " nhé", " đi", " bot", " mimo", " ?", " ha"]
THEME_QUOTAS_10K = {
    "cafe_social": 1000, "cafe_buy_food": 700, "income_salary": 900, "income_bonus": 700, "income_business": 700,
    "income_transfer": 900, "income_refund": 700, "record_not_action": 900, "sub_entertainment": 700,
    "record_housing": 550, "record_transport": 700, "record_food_general": 700, "social_gift": 500,
    "entertainment_drink": 550, "health_education": 500, "shopping_essentials": 500,
}

# --- note patterns (wording of our own; {t} item, {v} verb, {p} place, {m} money, {w} way of paying, {f} filler) ---
NOTE_VERBS = ["mua", "lấy", "đặt", "gọi", "sắm"]
NOTE_PLACES = {
    "street": ["quán đầu ngõ", "chợ sáng", "bến xe", "phố đi bộ"],
    "office": ["cửa hàng trên mạng", "tầng trệt công ty", "trung tâm quận"],
    "home": ["tiệm gần nhà", "siêu thị khu phố", "nhà ngoại"],
}
PLACE_OF_LABEL = {
    "Food": "street", "Transport": "street", "Entertainment": "street", "Shopping": "office", "Beauty": "office", "Education": "office",
    "Housing": "home", "Essentials": "home", "Health": "home",
}
NOTE_WAYS = ["quét mã", "thẻ", "tiền lẻ", "ví điện tử"]
NOTE_FILLERS = ["thế là hết ngày", "ghi lại kẻo quên", "tạm ổn", "lần sau ít hơn"]
BUCKET_PATTERNS = {
    "Food": ["{v} {t} ở {p}, tốn {m}", "bữa này có {t}, {m}"],
    "Transport": ["{t} cho chuyến này: {m}"],
    "Housing": ["kỳ này {t} phải trả {m}"],
    "Shopping": ["{v} {t} trên {p}, giá {m}"],
    "Beauty": ["{t} để chăm da {m}"],
    "Health": ["{t} theo toa, {m}"],
    "Education": ["{t} cho lớp mới {m}"],
    "Entertainment": ["tối qua {t}, tiêu {m}"],
    "Social": ["góp {t} với mọi người {m}"],
    "Essentials": ["{v} {t} dùng trong nhà {m}", "{t} lấy ở {p}, {m}"],
}
PAD_PATTERNS = [
    ("khoản lặt vặt trong ngày {m}", "Others"), ("gửi xe và phí đường {m}", "Transport"), ("nạp lại gói mạng {m}", "Housing"),
    ("đồ ăn nhẹ giữa giờ {m}", "Food"), ("một buổi học thử {m}", "Education"),
]
SPEND_PATTERNS = [
    "{t} ở {p} vừa tốn {m}, trả bằng {w}", "ghé {p} lấy {t}, {m} theo {w}", "{m} cho {t}, {f}", "hóa đơn {p}: {t} {m}",
    "{w} {m} tiền {t} tại {p}", "{t} xong ở {p}, bớt {m}, {f}", "{p} bán {t} giá {m}, {w}", "{t} {m} nhé, {f}",
    "dat {t} o {p} gia {m}", "paid {m} for {t} near {p}",
]
EARN_PATTERNS = [
    "{t} đem về {m}, nhận qua {w}", "cộng {m} nhờ {t}", "khách trả {m} cho {t} ở {p}", "khoản {t} đã về {m}, {f}",
    "{w} báo có {m} từ {t}", "got {m} for {t}", "tien {t} ve {m}",
]
NOISE_PATTERNS = [
    "lát nữa gặp ở {p}", "{p} hôm nay đông quá", "nhớ gọi cho tôi, {f}", "ai rảnh ghé {p} không", "trời mưa rồi, {f}",
]
