"""Word lists and patterns of the content rules."""

from __future__ import annotations

# The lists and patterns below must be these for the rules to give the results they are specified to give.

NOISE = [
    r"导航.*?菜单.*?",
    r"首页.*?登录.*?注册",
    r"版权所有.*?\d{4}.*?",
    r"Copyright.*?\d{4}.*?",
    r"备案号.*?ICP.*?",
    r"友情链接.*?",
    r"相关推荐.*?",
    r"广告.*?",
    r"Advertisement.*?",
    r"点击.*?查看.*?",
    r"更多.*?内容.*?",
    r"加载.*?中.*?",
    r"正在.*?加载.*?",
    r"网络.*?错误.*?",
    r"刷新.*?重试.*?",
    r"登录.*?查看.*?更多.*?",
    r"下载.*?APP.*?",
    r"打开.*?应用.*?",
    r"扫码.*?下载.*?",
]
PLATFORM_NOISE = {
    "weibo": [r"转发\s*\d*\s*评论\s*\d*\s*赞\s*\d*", "展开全文", "收起全文", "查看图片", "网页链接", "全文", "O网页链接"],
    "bilibili": [
        r"投币\s*\d*\s*收藏\s*\d*\s*分享\s*\d*",
        r"点赞\s*\d*",
        r"播放\s*\d*",
        r"弹幕\s*\d*",
        "稍后再看",
        "添加到稍后再看",
        "已添加到稍后再看",
    ],
    "xiaohongshu": [r"点赞\s*\d*", r"收藏\s*\d*", r"评论\s*\d*", r"分享\s*\d*", "查看全文", "展开"],
    "douyin": [r"点赞\s*\d*", r"评论\s*\d*", r"分享\s*\d*", r"收藏\s*\d*", "关注", "已关注"],
}
BILIBILI_SPANS = [
    "投币.*?收藏.*?分享",
    "点赞.*?投币.*?收藏",
    "三连.*?支持",
    "弹幕.*?评论区",
    "关注.*?订阅",
    "广告.*?推广",
    "版权.*?声明",
]
TITLE_SUFFIX = r"[-_|].*?(微博|bilibili|小红书|抖音).*?$"

REJECT_WORDS = ["404", "403", "500", "错误", "异常", "无法访问", "页面不存在", "not found", "error"]
LOGIN_WORDS = ["登录", "注册", "login", "register", "sign in", "sign up"]

MISSING_USER = [
    "该昵称目前不存在",
    "昵称不存在",
    "用户不存在",
    "账号不存在",
    "用户名不存在",
    "找不到用户",
    "无此用户",
    "user not found",
    "account not found",
    "profile not found",
    "抱歉，该昵称目前不存在哦",
]
ACCESS_ERROR = ["访问异常", "页面异常", "无法访问", "访问受限", "页面无法访问", "access denied", "forbidden", "unauthorized"]
HTTP_ERROR = ["404", "403", "500", "502", "503", "not found", "server error"]
LOGIN_ERROR = ["请登录", "需要登录", "登录后查看", "login required", "please login", "登录", "login", "注册", "register", "验证码"]

#: (type, severity, strategy, phrases), in the order in which they are tried.
CRAWL_ERRORS = [
    (
        "navigation",
        "medium",
        "multi_level_retry",
        [
            "page is navigating",
            "changing the content",
            "navigation timeout",
            "page.content: unable to retrieve content",
            "target closed",
            "execution context was destroyed",
            "page crashed",
            "page.goto",
            "navigation failed",
            "page not found",
        ],
    ),
    (
        "network",
        "high",
        "network_retry",
        [
            "connection refused",
            "connection reset",
            "connection timeout",
            "network error",
            "dns resolution failed",
            "host unreachable",
            "connection aborted",
            "socket timeout",
            "ssl error",
        ],
    ),
    (
        "timeout",
        "medium",
        "timeout_retry",
        [
            "timeout",
            "timed out",
            "deadline exceeded",
            "request timeout",
            "response timeout",
            "operation timeout",
            "wait timeout",
        ],
    ),
    (
        "bot_detection",
        "high",
        "stealth_retry",
        [
            "access denied",
            "forbidden",
            "blocked",
            "captcha",
            "verification",
            "robot",
            "bot detected",
            "suspicious activity",
            "rate limit",
            "too many requests",
            "请验证",
            "验证码",
            "访问被拒绝",
        ],
    ),
    (
        "resource",
        "low",
        "resource_retry",
        [
            "failed to load",
            "resource not found",
            "script error",
            "stylesheet not loaded",
            "image load failed",
            "font load failed",
        ],
    ),
    (
        "auth",
        "high",
        "auth_retry",
        [
            "unauthorized",
            "authentication required",
            "login required",
            "session expired",
            "invalid credentials",
            "access token",
        ],
    ),
    (
        "parsing",
        "low",
        "parsing_retry",
        ["parse error", "invalid html", "malformed content", "encoding error", "charset error", "content type"],
    ),
]
SUGGESTIONS = {
    ("weibo", "navigation"): "微博页面导航复杂，建议增加等待时间",
    ("weibo", "bot_detection"): "微博反爬虫严格，建议使用更隐蔽的配置",
    ("weibo", "timeout"): "微博加载较慢，建议增加超时时间",
    ("bilibili", "navigation"): "B站视频页面加载复杂，建议暂停视频播放",
    ("bilibili", "resource"): "B站资源较多，建议禁用部分资源加载",
    ("bilibili", "timeout"): "B站内容丰富，建议增加处理时间",
    ("xiaohongshu", "bot_detection"): "小红书检测较严，建议模拟真实用户行为",
    ("xiaohongshu", "navigation"): "小红书页面动态加载，建议增加滚动操作",
    ("douyin", "navigation"): "抖音页面复杂，建议暂停视频并增加等待",
    ("douyin", "bot_detection"): "抖音反爬虫强，建议使用随机延迟",
}
DEFAULT_SUGGESTION = "建议检查网络连接和页面状态"
RETRY_WAITS = {
    "network_retry": [5, 10, 20],
    "timeout_retry": [8, 15, 25],
    "stealth_retry": [10, 20, 30],
    "multi_level_retry": [8, 15, 20],
    "resource_retry": [3, 6, 12],
    "auth_retry": [5, 10, 15],
    "parsing_retry": [2, 4, 8],
    "default_retry": [5, 10, 15],
}

CRITICAL_WORDS = [
    "404",
    "403",
    "500",
    "502",
    "503",
    "页面不存在",
    "page not found",
    "not found",
    "访问异常",
    "页面异常",
    "无法访问",
    "访问受限",
    "access denied",
    "forbidden",
    "unauthorized",
    "该昵称目前不存在",
    "昵称不存在",
    "用户不存在",
    "账号不存在",
    "user not found",
    "account not found",
    "profile not found",
]
SOFT_STATIC = [
    "关于我们",
    "about",
    "联系我们",
    "contact",
    "帮助中心",
    "help",
    "服务条款",
    "terms",
    "隐私政策",
    "privacy",
    "免责声明",
    "导航",
    "navigation",
    "菜单",
    "menu",
]
GENERIC_DYNAMIC = [
    "发布",
    "post",
    "评论",
    "comment",
    "分享",
    "share",
    "内容",
    "content",
    "文章",
    "article",
    "新闻",
    "news",
    "用户",
    "user",
    "时间",
    "time",
    "更新",
    "update",
]
HOST_DYNAMIC = {
    "weibo.com": ["转发", "评论", "赞", "超话", "话题", "博主", "微博", "发布", "分享", "粉丝", "关注", "动态", "内容", "用户"],
    "bilibili.com": [
        "投币",
        "收藏",
        "分享",
        "av",
        "bv",
        "播放",
        "弹幕",
        "up主",
        "视频",
        "番剧",
        "直播",
        "专栏",
        "动画",
        "游戏",
        "bilibili",
        "b站",
    ],
    "xiaohongshu.com": [
        "笔记",
        "种草",
        "好物",
        "推荐",
        "分享",
        "美妆",
        "穿搭",
        "生活",
        "旅行",
        "美食",
        "护肤",
        "彩妆",
        "小红书",
    ],
    "douyin.com": ["抖音", "短视频", "音乐", "特效", "挑战", "直播", "作品", "粉丝", "关注", "点赞", "评论", "douyin"],
}

#: (indicators, least number of them) of each platform.
FEATURES = {
    "bilibili": (
        [
            "bilibili.com",
            "b23.tv",
            "up主",
            "up",
            "播放",
            "弹幕",
            "投币",
            "收藏",
            "三连",
            "av号",
            "bv号",
            "番剧",
            "直播",
            "热门",
            "推荐",
            "排行榜",
            "新番",
            "游戏",
            "科技",
            "生活",
            "娱乐",
            "音乐",
            "舞蹈",
            "视频",
            "动态",
        ],
        2,
    ),
    "weibo": (["weibo.com", "微博", "转发", "评论", "赞", "博主", "粉丝", "关注", "话题", "@", "#", "超话", "热搜", "实时"], 2),
    "xiaohongshu": (
        ["xiaohongshu", "小红书", "笔记", "种草", "好物", "分享", "推荐", "测评", "攻略", "教程", "心得", "体验"],
        1,
    ),
    "douyin": (
        ["douyin", "抖音", "视频", "短视频", "直播", "音乐", "舞蹈", "搞笑", "美食", "旅行", "时尚", "创作者"],
        1,
    ),
}
STATIC_TYPE = ["首页", "home", "index", "关于我们", "about", "登录", "login"]
DYNAMIC_TYPE = ["发布", "更新", "最新", "动态", "帖子", "post", "视频", "video", "评论", "comment"]
WEIBO_TYPE = ["微博", "weibo", "转发", "点赞", "话题", "博主"]

#: (patterns of the author's name, pattern of the URL's id, what goes before the id, default name).
AUTHORS = {
    "weibo": ([r"博主[：:]([^\s]+)", r"@([^\s]+)", r"作者[：:]([^\s]+)"], r"/u/(\d+)", "微博用户_", "微博用户"),
    "xiaohongshu": ([r"作者[：:]([^\s]+)", r"博主[：:]([^\s]+)", r"@([^\s]+)"], None, "", "小红书用户"),
    "douyin": ([r"@([^\s]+)", r"作者[：:]([^\s]+)", r"创作者[：:]([^\s]+)"], None, "", "抖音用户"),
    "bilibili": (
        [r"UP主[：:](\S+)", r"up主[：:](\S+)", r"作者[：:](\S+)", r"博主[：:](\S+)"],
        r"/space/(\d+)",
        "UP主_",
        "B站UP主",
    ),
}
XHS_TAG_WORDS = ["种草", "好物", "推荐", "测评", "攻略", "教程", "分享"]
BILIBILI_TAGS = ["bilibili", "B站", "哔哩哔哩"]
BILIBILI_CATEGORIES = [r"(游戏|科技|生活|娱乐|音乐|舞蹈|动画|番剧|电影|电视剧)", r"(UP主|直播|投稿|原创|转载)"]
BILIBILI_VIDEOS = [r"https?://www\.bilibili\.com/video/[^\s]+", r"https?://b23\.tv/[^\s]+", r"BV[0-9A-Za-z]+", r"av\d+"]
IMAGE_URL = r"https?://[^\s]+\.(?:jpg|jpeg|png|gif|webp)"

IMAGE_PARTS = [
    ".jpg",
    ".jpeg",
    ".png",
    ".gif",
    ".bmp",
    ".webp",
    ".svg",
    ".ico",
    ".tiff",
    ".tif",
    "sinaimg.cn",
    "qpic.cn",
    "hdslb.com",
    "xiaohongshu.com/sns/img",
    "/orj360/",
    "/bmiddle/",
    "/large/",
    "/thumb/",
    "img.",
    "image.",
    "pic.",
    "photo.",
]
IMAGE_PATH = "/(img|image|pic|photo|thumb|avatar|logo)s?/"
STATIC_URLS = [
    r"/(index|home|main)\b",
    r"/about\b",
    r"/contact\b",
    r"/help\b",
    r"/terms\b",
    r"/privacy\b",
    r"/login\b",
    r"/register\b",
    "/static/",
    "/assets/",
    r"\.(css|js|png|jpg|jpeg|gif|ico)$",
]
WEIBO_FORBIDDEN = ["/hot/search", "/hot/", "/search", "/login", "/register", "/home", "/index", "/about", "/help"]

# Names of weibo that are no user's.
RESERVED_NAMES = ["admin", "api", "www", "mail", "ftp", "localhost", "test", "weibo", "sina", "home", "index", "login", "register"]

# Words that make a search result no news; words and paths of static results; words of dynamic ones.
NEWS_EXCLUDED = ["广告", "ad", "推广", "招聘"]
RESULT_STATIC = [
    "首页",
    "home",
    "index",
    "主页",
    "官网",
    "关于",
    "about",
    "联系",
    "contact",
    "帮助",
    "help",
    "登录",
    "login",
    "注册",
    "register",
    "下载",
    "download",
    "条款",
    "terms",
    "隐私",
    "privacy",
    "免责",
    "disclaimer",
    "导航",
    "navigation",
    "菜单",
    "menu",
    "404",
    "error",
]
RESULT_DYNAMIC = [
    "发布",
    "更新",
    "最新",
    "动态",
    "帖子",
    "post",
    "视频",
    "video",
    "直播",
    "live",
    "分享",
    "share",
    "评论",
    "comment",
    "点赞",
    "like",
    "转发",
    "repost",
    "话题",
    "topic",
    "热门",
    "trending",
    "今日",
    "today",
    "用户",
    "user",
    "博主",
    "blogger",
    "创作者",
    "creator",
]
RESULT_PATHS = ["/about", "/help", "/contact", "/terms", "/privacy", "/login", "/register", "/index", "/home"]

# Where a page's content is looked for, in this order, and what in it is none.
CONTENT_SELECTORS = [
    "main",
    "article",
    ".content",
    ".post-content",
    ".article-content",
    ".news-content",
    "#content",
    ".entry-content",
    ".post-body",
]
NO_CONTENT = ["script", "style", "nav", "header", "footer", "aside"]
# Parts of image addresses that mean decoration.
DECORATION = ["icon", "logo", "avatar", "button"]

# The same lists for results of video pages, and for notes and videos of two more platforms.
DOUYIN_STATIC = [
    "首页",
    "home",
    "index",
    "主页",
    "官网",
    "下载",
    "关于",
    "about",
    "联系",
    "contact",
    "帮助",
    "help",
    "登录",
    "login",
    "注册",
    "register",
    "设置",
    "settings",
    "条款",
    "terms",
    "隐私",
    "privacy",
    "版权",
    "copyright",
]
DOUYIN_DYNAMIC = [
    "视频",
    "video",
    "短视频",
    "抖音",
    "douyin",
    "tiktok",
    "播放",
    "play",
    "观看",
    "watch",
    "直播",
    "live",
    "创作者",
    "creator",
    "博主",
    "blogger",
    "达人",
    "发布",
    "post",
    "更新",
    "update",
    "最新",
    "latest",
    "热门",
    "trending",
    "推荐",
    "recommend",
    "分享",
    "share",
]
DOUYIN_PATHS = ["/about", "/help", "/contact", "/terms", "/privacy", "/login", "/register", "/download", "/index", "/home"]
NOTE_STATIC = ["首页", "主页", "登录", "注册", "帮助", "关于我们", "服务条款", "隐私政策", "导航", "菜单"]
NOTE_PATHS = ["/home", "/index", "/main", "/login", "/register", "/help", "/about"]
XHS_DYNAMIC = ["小红书", "xiaohongshu", "笔记", "种草", "分享", "测评", "推荐", "体验", "使用心得", "好物"]
BILIBILI_DYNAMIC = ["bilibili", "b站", "哔哩哔哩", "up主", "视频", "番剧", "直播", "动画", "游戏", "科技"]

# What stands in title or description of a platform's results; without a list everything passes.
RESULT_WORDS = {"weibo": ["微博", "weibo"], "douyin": ["抖音", "douyin", "tiktok", "短视频"]}
# Records of results: the author without another, what a missing description is made of, and the first tags.
RESULT_AUTHORS = {"weibo": "微博用户", "douyin": "抖音创作者", "xiaohongshu": "小红书博主", "bilibili": "B站UP主"}
RESULT_LEADS = {
    "weibo": "微博动态：",
    "douyin": "抖音短视频：",
    "xiaohongshu": "小红书笔记：",
    "bilibili": "B站视频：",
    "news": "新闻报道：",
}
RESULT_TAGS = {
    "weibo": ["微博", "社交媒体"],
    "douyin": ["抖音", "短视频"],
    "xiaohongshu": ["小红书", "生活分享", "种草"],
    "bilibili": ["B站", "视频", "bilibili"],
    "news": ["新闻", "资讯"],
}
NEWS_SOURCES = {"without": "新闻编辑部", "too_long": "新闻媒体"}
# The service's own authors of results.
SERVICE_AUTHORS = {"weibo": "微博用户", "douyin": "抖音创作者", "xiaohongshu": "小红书博主", "bilibili": "B站UP主", "news": "新闻编辑"}
SERVICE_AUTHOR = "创作者"

# Where results stand on the pages of search engines: a result, its linked title, its text.
ENGINE_RESULTS = {
    "baidu": (".result.c-container", "h3 a", ".c-abstract"),
    "sogou": (".results .result", ".title a", ".content"),
    "bing": (".b_algo", "h2 a", ".b_caption p"),
}
RESULT_NAVIGATION = ["登录", "注册", "首页"]
RESULT_TEXT = "相关搜索结果"

# Where a page's author stands, in this order, and who it is by the page's address.
AUTHOR_SELECTORS = [
    '[rel="author"]',
    ".author",
    ".author-name",
    ".byline",
    ".post-author",
    '[class*="author"]',
    '[class*="writer"]',
]
URL_AUTHORS = {"weibo.com": "微博用户", "bilibili.com": "B站UP主", "xiaohongshu.com": "小红书用户", "douyin.com": "抖音用户"}
URL_AUTHOR = "未知作者"
# Titles by parts of an address's path; an empty part fits every path.
URL_TITLES = {
    "weibo": [("/u/", "微博用户动态"), ("/status/", "微博动态")],
    "bilibili": [("/video/", "B站视频"), ("/space/", "B站用户空间")],
    "xiaohongshu": [("", "小红书笔记")],
    "douyin": [("", "抖音视频")],
}

# Requests and console messages: parts of addresses of interfaces, of watchful sites; of messages of a block.
API_PARTS = ["/api/", "/ajax/", "/json", ".json"]
SUSPICIOUS_PARTS = [
    "captcha",
    "verify",
    "challenge",
    "protection",
    "security",
    "anti-bot",
    "bot-detection",
    "fingerprint",
    "tracking",
]
BLOCKED_MESSAGES = [
    "access denied",
    "blocked",
    "captcha",
    "verification required",
    "bot detected",
    "suspicious activity",
    "rate limit exceeded",
]
# Retries by the kind of error and the attempt (the third and later ones alike): page timeout in milliseconds, and
# seconds of delay, at first and more for each attempt; then those of other kinds, attempt by attempt.
RETRY_TIMEOUTS = {
    "network": (120_000, 60_000, 10, 5),
    "timeout": (180_000, 90_000, 20, 10),
    "bot_detection": (240_000, 0, 25, 15),
    "resource": (90_000, 0, 5, 0),
    "auth": (120_000, 0, 15, 0),
    "parsing": (60_000, 0, 3, 0),
}
OTHER_TIMEOUTS = [(90_000, 5), (180_000, 20), (240_000, 30)]
SLOW_PLATFORMS = ["weibo", "xiaohongshu", "douyin", "bilibili"]
SLOW_TIMEOUT, SLOW_DELAY = 1.5, 1.2

# Selectors of what only users see, and of what asks to log in, by platform, in the order in which they are tried (fixed values).
USER_NAMES = [".gn_name", ".username", ".user-name"]
WEIBO_USER = [".gn_name", ".WB_miniblog", ".gn_usercard"]
WEIBO_LOGIN = [".loginBtn", ".login", ".WB_login"]
DOUYIN_USER = [".user-info", ".avatar-wrap", ".user-name"]
DOUYIN_LOGIN = [".login-button", ".login-text"]
XHS_AVATARS = [
    "img[alt*='头像']",
    "img[alt*='avatar']",
    ".user-avatar img",
    ".profile-avatar img",
    "[data-testid='user-avatar'] img",
    ".header-user img",
    ".nav-user img",
]
XHS_NAMES = [
    ".user-name",
    ".username",
    ".user-info-name",
    ".profile-name",
    "[data-testid='username']",
    ".header-user-name",
    ".nav-username",
]
XHS_MENUS = [
    ".user-menu",
    ".user-dropdown",
    ".profile-menu",
    ".header-user-menu",
    "[data-testid='user-menu']",
    ".user-actions",
    ".account-menu",
]
XHS_USER_PATHS = ["/user/", "/profile/", "/settings/", "/account/"]
XHS_INDICATORS = [".user-avatar", '[class*="user"][class*="info"]', 'img[src*="avatar"]']
XHS_LOGIN = [
    ".login-btn",
    ".sign-in",
    ".login-button",
    ".signin-btn",
    "button[type='submit']",
    "[data-testid='login-btn']",
    "a[href*='login']",
    ".auth-btn",
    ".login-link",
    ".signin-link",
]
