"""Dictionaries and patterns of the rules.

Fixed values: right results depend on these words, weights and orders as they stand.
"""

from __future__ import annotations

#: Scene categories in the order that breaks ties.
CATEGORY_PATTERNS = {
    "hospital": r"(?:병원|치료|수술|입원|퇴원|회복|쾌유|의사|간호|투병|완치|부상|통증|응급실|건강검진|환[고자아]|진료|진단|건강\s*(?:이상|악화|관리|회복|문제|주의))",
    "money": r"(?:기부(?:금|자|액)?|성금|쾌척|매출|수익(?:금)?|상금|계약금|재산|플렉스|건물(?:주)?|부동산|자산|거액|잭팟|부자|억만장자|(?:\d+|몇|수십|수백|수천)\s*억(?![가-힣])|(?:\d+|몇|수십|수백)\s*만\s*원)",
    "smartphone": r"(?:음원차트|멜론|유튜브|조회수|스트리밍|투표|검색어|\bSNS\b|인터넷|댓글|실검|모바일|스마트폰|핸드폰|휴대폰|인스타그램|틱톡|온라인|네티즌|차트\s*1위|차트\s*올킬)",
    "emotion": r"(?:눈물(?:바다)?|감동(?:적)?|감격|울컥|가슴\s*(?:이|속|깊이|뭉클|벅찬)|뭉클|기쁨|환희|위로|슬픔|오열|벅찬|먹먹|눈시울|애절|눈물을\s*참|가슴이\s*찢)",
    "business": r"(?:전속계약|계약(?:서)?|전속|소속사|광고|(?:\bCF\b)|모델|대상(?:을|을받은|수상)?|시상식|트로피|1위|일위|1등|일등|수상(?:식)?|우승|브랜드|완판|홍보대사|석권)",
    "concert": r"(?:콘서트|공연|가요제|전국투어|마이크|조명|열창|무대매너|무대|축제|페스티벌|라이브|가창력|앙코르|엔딩무대|현장열기)",
    "audience": r"(?:팬클럽|팬덤|영웅시대|환호|박수|응원(?:가|봉)?|함성|떼창|관객|관중|기립박수|팬분(?:들)?|팬들|열성팬|\b팬\b)",
}
CATEGORY_WEIGHTS = {"hospital": 1.5, "money": 1.4, "emotion": 1.3, "smartphone": 1.2, "business": 1.1, "concert": 1.0, "audience": 1.0}
KEYWORD_CATEGORIES = {
    "관객": "audience", "팬": "audience", "환호": "audience", "응원": "audience", "감동": "emotion", "눈물": "emotion", "슬픔": "emotion", "기쁨": "emotion",
    "병원": "hospital", "의사": "hospital", "치료": "hospital", "수술": "hospital", "돈": "money", "현금": "money", "재산": "money", "수익": "money",
    "스마트폰": "smartphone", "핸드폰": "smartphone", "휴대폰": "smartphone", "전화": "smartphone", "콘서트": "concert", "공연": "concert", "무대": "concert", "노래": "concert",
    "비즈니스": "business", "사업": "business", "계약": "business", "회사": "business",
}
CRITICAL_TERMS = ["사망", "은퇴", "퇴출", "파문", "불화", "비난 폭주", "폭로", "참변", "비보", "구속", "음주운전", "도박", "피소", "체포"]
CLICKBAIT = ["전 국민 충격", "경악", "충격적인", "발칵", "눈물바다", "오열", "충격 고백", "경악을 금치", "충격에 빠", "전 국민이 경악", "충격 실체", "눈물 겨운"]
PROGRAMS = ["미스터트롯", "미스트롯", "불후의 명곡", "현역가왕", "사랑의 콜센타", "아침마당", "살림남", "뽕숭아학당", "트롯 전국체전", "복면가왕", "골든걸스", "미스터로또", "음악중심", "인기가요", "뮤직뱅크", "더트롯쇼"]
#: Numbers that tell nothing about facts.
BENIGN_NUMBERS = ["60초", "3초", "10초", "30초", "1초", "2초", "5초", "1분", "2분", "3분", "5070", "1단계", "2단계", "3단계", "첫번째", "두번째", "세번째", "1번째", "2번째", "3번째"]
DATE = r"(\d{1,4})\s*년(?:\s*(\d{1,2})\s*월(?:\s*(\d{1,2})\s*일)?)?|(\d{1,2})\s*월\s*(\d{1,2})\s*일"
RANK = r"(?:TOP\s*|top\s*)?(\d+)\s*(?:위|등)"
AMOUNT = r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(조|억|만|천|백)?\s*(원|회|뷰|명|표|곡|장|개|점|석|%|퍼센트|세|달러)?"
FIRST_RANK = ["1위", "1등", "일위", "우승", "정상", "1 위", "1 등"]
MAJOR_SCALES, MAJOR_UNITS = ["억", "조"], ["회", "뷰", "원", "명", "표", "스트리밍"]
#: Lines of an article that are not its text.
LINE_JUNK = ["바로가기", "메뉴닫기", "전체서비스", "상단영역", "스타뉴스", "검색버튼", "구독자수", "로그인", "회원가입"]
LINE_RIGHTS = ["무단 전재", "재배포 금지", "저작권자", "기자 =", "기자=", "기자]"]
LINE_STARTS = ["▶", "※", "ⓒ"]
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
#: Types of issues by what the message holds, in this order (case ignored).
ISSUE_LADDER = [("caption|자막", "caption_overflow"), ("숫자|number|통계", "number_discrepancy"), ("사진|photo", "photo_repetition"), ("b-roll|broll|짤", "broll_repetition"), ("hook|후킹", "hook_repetition"), ("가수|인물|singer", "singer_mismatch"), ("화면|frame", "scene_mismatch"), ("해상도|fps|비트레이트", "video_spec_mismatch"), ("싱크|audio|음성", "audio_sync"), ("ai_qa_not_run|미실행", "ai_qa_not_run")]
#: Places of an article's title and text on a page: (tag, attribute, value), the first that is there.
TITLE_PLACES = [("h2", "id", "title_area"), ("h3", "id", "articleTitle"), ("h3", "class", "tit_view"), ("div", "class", "(?i)article_tit|view_title|headline|news_title"), ("h1", "", "")]
BODY_PLACES = [("div", "id", "CLtag"), ("td", "class", "article"), ("article", "id", "dic_area"), ("div", "id", "articleBodyContents"), ("div", "id", "newsct_article"), ("div", "id", "articeBody"), ("div", "class", "article_view"), ("div", "id", "article-view-content-div"), ("div", "class", "article-body"), ("div", "class", "view_cont"), ("div", "class", "news_body"), ("div", "id", "news_body_area"), ("div", "class", "view_text"), ("div", "id", "content")]
#: Names of artists in the order that breaks ties, and the other names by which texts call them.
ARTISTS = [
    "임영웅", "박서진", "이찬원", "영탁", "정동원", "김호중", "송가인", "장민호", "안성훈", "진해성", "김용빈", "손태진", "배아현", "오유진", "김태연", "전유진",
    "마이진", "박지현", "최수호", "나상도", "김희재", "홍지윤", "양지은", "강혜연", "황영웅", "에녹", "신성", "민수현", "박성온", "정서주", "미스김",
]
ALIASES = {
    "임영웅": ["영웅", "영웅시대", "히어로", "HERO", "임히어로", "영웅님", "영웅씨"], "박서진": ["서진", "닻별", "장구의 신", "서진이", "서진님", "박서진님"],
    "이찬원": ["찬원", "찬또배기", "찬또", "찬스", "찬원님", "이찬원님"], "영탁": ["박영탁", "탁이", "영탁님", "영탁이", "탁쇼"],
    "정동원": ["동원", "동원이", "우주총동원", "정동원군", "동원군"], "김호중": ["호중", "트바로티", "아리스", "호중님", "김호중님"],
    "송가인": ["가인", "가인이", "어게인", "송가인이어라", "가인님"], "장민호": ["민호", "민호오빠", "민호님", "장민호님"],
    "안성훈": ["성훈", "후니용이", "안성훈님"], "진해성": ["해성", "진해성님"], "김용빈": ["용빈", "김용빈님"], "손태진": ["태진", "손태진님"],
    "배아현": ["아현", "배아현님"], "오유진": ["유진", "오유진양"], "김태연": ["태연", "김태연양"], "전유진": ["전유진양"], "마이진": ["화진", "마이진님"],
    "박지현": ["지현", "박지현님"], "최수호": ["수호", "최수호님"], "나상도": ["상도", "나상도님"], "김희재": ["희재", "김희재님", "희랑별"],
    "홍지윤": ["지윤", "홍지윤님"], "양지은": ["지은", "양지은님"], "강혜연": ["혜연", "강혜연님"], "황영웅": ["황영웅님"],
}
QUOTED = "['\"‘“「『<]([^'\"’”」』>]{2,25})['\"‘“「『>]"
SECTION = r"\[사진\s*\d+\]|\[이미지\s*\d+\]|###\s*\d+|【\d+】"
#: Elements of a page that hold no article, words of the classes and ids of those that hold none (case ignored), and elements in it that are no text.
PAGE_FRAME = {"header", "nav", "footer", "aside", "form"}
PAGE_JUNK = "gnb|menu|nav|header|footer|sidebar|banner|util|quick|share|sns"
PAGE_NOT_TEXT = {"script", "style", "iframe", "button", "figcaption", "em"}
