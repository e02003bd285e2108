"""Fixed values.

Every word list, alias table, pattern and threshold below is a fixed value: results are only right
when they equal these exactly.  They are kept together, in their natural order, and nothing here
contains logic.  Callers may pass their own lists to the functions that use them.
"""

# --- field-name roles: canonical suffixes per role -------------------------------------------
ROLE_TERMS = {
    "id": ["jobid", "positionid", "postingid", "postid", "requisitionid", "demandcode"],
    "title": ["jobtitle", "jobname", "jobadname", "positionname", "positiontitle", "postingtitle",
              "postname", "requisitiontitle"],
    "location": ["location", "locations", "city", "cityname", "workplace", "workplacename", "workplacecode"],
    "category": ["department", "departmentname", "team", "category", "categoryname", "jobfunction",
                 "functionname"],
    "responsibilities": ["description", "jobdescription", "responsibility", "responsibilities",
                         "jobresponsibility", "duties", "postduties"],
    "requirements": ["requirement", "requirements", "jobrequirement", "qualification", "qualifications"],
    "recruitment_type": ["recruitmenttype", "recruittype", "projecttype", "employmenttype"],
    "url": ["url", "joburl", "detailurl", "applyurl", "clickurl"],
}

# --- job-description field aliases, in order of preference -----------------------------------
JD_DESCRIPTION = [
    "_generic_description", "jobDescription", "job_description", "jobdesc", "jobDesc", "description",
    "positionDescription", "position_description", "content", "contents", "jd_content", "jdContent",
    "jd", "overview", "summary", "workContent", "work_content", "jobBody", "job_body",
    "detailDescription", "detail_description", "postContent", "post_content", "richText", "rich_text",
    "desc", "responsibilitiesDescription", "responsibilityDescription", "requirementsDescription",
    "requirementDescription",
]
JD_RESPONSIBILITY = [
    "_generic_responsibilities", "jobResponsibility", "job_responsibility", "responsibilities",
    "responsibility", "jobResponsibilities", "duty", "duties", "jobDuty", "job_duty", "postDuties",
    "post_duties", "workDuty", "work_duties",
]
JD_REQUIREMENT = [
    "_generic_requirements", "jobRequirement", "job_requirement", "requirements", "requirement",
    "require", "qualifications", "qualification", "jobRequirements", "requirementsDesc",
    "requirements_description", "abilityRequirement", "ability_requirement", "competency",
    "competencies", "serviceCondition", "service_condition",
]
JD_WRAPPERS = ["projectPositionDto", "positionDto", "jobDto"]
JD_WRAPPED_RESPONSIBILITY = ["jobResponsibility", "responsibilities", "duty", "duties"]
JD_WRAPPED_REQUIREMENT = ["jobRequirement", "requirements", "requirement", "qualifications"]
TEXT_OBJECT_KEYS = ["text", "content", "value", "name", "description"]
MIN_SPLIT_CHARS = 40

# fields a detail record may be read from when structure is recovered later
ENRICH_SOURCE_FIELDS = [
    "jobDescription", "description", "job_description", "content", "requirementsDescription",
    "positionDescription", "position_description", "jobdesc", "jobDesc", "jd_content", "jdContent", "jd",
    "overview", "summary", "workContent", "work_content", "jobBody", "job_body", "detailDescription",
    "detail_description", "postContent", "post_content", "richText", "rich_text", "desc",
]
# fields whose credible detail value may replace a list teaser
JD_VALUE_FIELDS = ["description", "overview", "content", "jobDescription", "responsibilities",
                   "requirements", "qualifications"]

# --- heading vocabularies (five distinct ones; do not merge) ---------------------------------
BODY_RESPONSIBILITY = [
    "岗位职责", "工作职责", "职位职责", "职责描述", "岗位描述", "工作内容", "职位描述", "责任描述",
    "主要职责", "工作职能", "responsibilities", "what you'll do", "what you will do", "the role",
    "job responsibilities", "key responsibilities", "about the role",
]
BODY_REQUIREMENT = [
    "任职要求", "任职资格", "职位要求", "岗位要求", "资格要求", "任职条件", "招聘要求", "应聘要求",
    "基本要求", "requirements", "qualifications", "what we're looking for", "what we are looking for",
    "what you bring", "basic qualifications", "preferred qualifications",
]
SPLIT_RESPONSIBILITY = [
    "responsibilities", "what you'll do", "what you will do", "the role", "岗位职责", "工作职责",
    "job responsibilities", "岗位描述", "职位职责",
]
SPLIT_REQUIREMENT = [
    "requirements", "qualifications", "what we're looking for", "what we are looking for",
    "what you bring", "任职要求", "任职资格", "岗位要求", "资格要求", "任职条件",
]
PAGE_RESPONSIBILITY = [
    "responsibilities", "job responsibilities", "position responsibilities", "role responsibilities",
    "what you'll do", "what you will do", "岗位描述", "岗位职责", "工作职责", "职位职责", "职责描述",
]
PAGE_REQUIREMENT = [
    "requirements", "qualifications", "job requirements", "position requirements",
    "what we're looking for", "what we are looking for", "任职要求", "任职资格", "职位要求", "岗位要求",
    "任职条件",
]
PAGE_END = ["工作地点", "招聘部门", "公司介绍", "部门介绍", "about the company", "about us",
            "apply for this job", "相关职位", "推荐职位"]
RENDERED_RESPONSIBILITY = ["岗位职责", "工作职责", "职位职责", "职责描述", "工作内容", "主要职责",
                           "Responsibilities"]
RENDERED_REQUIREMENT = ["任职要求", "任职资格", "岗位要求", "职位要求", "招聘要求", "基本要求",
                        "Requirements", "Qualifications"]
RENDERED_STOP = r"(?i)^(沪|京|粤|深).{0,20}(备|公安|ICP)|^©|^Copyright|^分享$|^收藏$|^打印$|^返回$|^关闭$"
CARD_RESPONSIBILITY = (r"(?i)[\[【]?\s*(?:岗位职责|工作职责|职位职责|职位描述|职责|responsibilities?|"
                       r"job description)\s*[\]】:：]?\s*")
CARD_REQUIREMENT = (r"(?i)[\[【]?\s*(?:任职要求|任职资格|岗位要求|职位要求|requirements?|qualifications?)"
                    r"\s*[\]】:：]?\s*")

JD_SIGNALS = ["job description", "description", "responsibilities", "requirements", "qualifications",
              "what you'll do", "what you will do", "what you'll bring", "what you will bring",
              "about the role", "岗位职责", "任职要求", "任职资格"]
JD_PENALTIES = ["related jobs", "share this job", "cookie settings", "privacy policy",
                "marketing preferences"]

# --- standard field aliases ------------------------------------------------------------------
STANDARD_FIELDS = {
    "company": ["company", "companyName", "company_name", "orgName", "corpName"],
    "department": ["department", "orgName", "departmentName", "deptName", "division", "orgFullName"],
    "education": ["education", "educationStr", "educationName", "educationText", "degree"],
    "job_category": ["postTypeName", "postTypeText", "jobCategory", "categoryName", "postNameType",
                     "functionName", "jobFunction"],
    "major": ["subject", "major", "majorStr", "majorName", "subjectName"],
    "recruitment_type": ["projectName", "project_name", "projectTitle", "recruitTypeName",
                         "recruitTypeStr", "batchName"],
    "headcount": ["recruitNumStr", "recruitNum", "recruitCount", "recruitNumber", "headCount", "hiringNum"],
    "publish_date": ["publishDate", "publishFirstDate", "publishTime", "publishAt", "createDate",
                     "releaseDate"],
}
WORKPLACE_ITEM_KEYS = ["name", "workPlace", "city"]
WORKPLACE_KEYS = ["workPlaceStr", "workPlace", "workPlaceName", "workLocation", "locationStr", "location"]
UPDATE_TIME_KEYS = ["updateTime", "updateTimestamp", "lastModifyTime"]
LABEL_KEYS = ["name", "title", "label", "city", "location"]
RECORD_ID_FIELDS = ["id", "job_id", "jobId", "jobPostId", "positionId", "requisitionId", "requisition_id"]
RECORD_TITLE_FIELDS = ["title", "name", "jobTitle", "positionName"]
RECORD_LOCATION_FIELDS = ["_generic_location", "location", "locations", "city", "cityName", "districtName",
                          "address", "workPlace", "workLocation", "city_list", "workPlaceCode"]
RECORD_URL_FIELDS = ["absolute_url", "url", "job_url", "jobUrl", "detail_url", "detailUrl", "apply_url",
                     "applyUrl", "click_url", "clickUrl"]
REAL_URL_FIELDS = ["url", "absolute_url", "job_url", "jobUrl", "detail_url", "detailUrl", "apply_url",
                   "applyUrl", "click_url", "clickUrl", "path", "slug"]
EMBEDDED_TITLE_KEYS = ["title", "name", "jobTitle", "jobName", "positionName"]

# --- identity --------------------------------------------------------------------------------
REQUISITION_KEYS = ["requisitionid", "requisition_id", "reqid", "req_id", "jobpostingid", "job_posting_id"]
POSTING_KEYS = ["jobid", "job_id", "postingid", "posting_id", "postid", "post_id"]
STABLE_KEYS = ["id", "positionid", "position_id", "internal_job_id"]
JOB_ROUTES = ["job", "jobs", "position", "positions", "post", "posts", "job-detail", "jobdetail", "detail",
              "details"]
TRACKING_PARAM = "(?i)(utm_|tracking|source|campaign|ref$)"
CAPTURE_ID_ALIASES = ["id", "jobid", "job_id", "positionid", "position_id", "postid", "postingid",
                      "requisitionid", "demandcode", "code"]
PATH_ID_QUERY = ["rid", "id", "jobid", "job_id", "positionid", "requisitionid"]
PATH_ID_SEGMENTS = ["rid", "id", "job", "jobid", "position", "positionid", "requisition", "requisitionid"]
ROUTE_QUERY_IDS = ["jobId", "job_id", "positionId", "position_id", "postingId", "requisitionId", "id"]
CARD_ID_ATTRS = ["data-job-id", "data-id", "data-position-id", "data-post-id"]
CARD_ROUTE_ATTRS = ["href", "data-href", "data-route"]

# --- capture parameters ----------------------------------------------------------------------
PAGE_ALIASES = ["page", "pageindex", "pageno", "currentpage"]
SIZE_ALIASES = ["pagesize", "limit", "size", "perpage"]
PAGE_NAMES = ["page", "pageno", "pagenum", "pageindex", "pagenumber", "currentpage", "current",
              "currentpageindex"]
OFFSET_NAMES = ["offset", "start", "startindex", "from", "fromindex", "skip"]
SIZE_NAMES = ["pagesize", "size", "limit", "pagelimit", "rows", "perpage"]
TOTAL_TIER1 = ["total", "totalcount", "total_count", "totalsize", "totalelements", "total_elements",
               "recordstotal", "records_total", "datacount", "totalnum", "total_num"]
TOTAL_TIER2 = ["count"]
SCOPE_ID_KEYS = ["nature", "project_id", "projectid", "recruitment_type", "recruitmenttype", "channel",
                 "campaign", "batch"]
SCOPE_LABEL_KEYS = ["recruitment_type_cn", "recruitmentTypeName", "nature_cn", "natureName"]
URL_FILTER_KEYS = ["location", "department", "team", "category", "keyword"]
URL_SCOPE_TERMS = ["campus", "social", "intern", "graduate", "experienced"]

# --- list scoring ----------------------------------------------------------------------------
SCORE_TITLE = ["title", "jobtitle", "job_title", "jobname", "positionname", "position_name",
               "projectpositionname", "positiontitle", "postname", "postingname", "jobadname", "recruitname",
               "name"]
SCORE_ID = ["id", "jobid", "job_id", "jobcode", "jobadid", "job_ad_id", "postid", "post_id", "postingid",
            "posting_id", "positionid", "position_id", "positioncode", "recruitid", "recruit_id",
            "requisitionid", "requisition_id"]
SCORE_LOCATION = ["location", "locations", "city", "cityname", "city_name", "country", "workplacecode",
                  "workplacestr", "worklocation"]
SCORE_CATEGORY = ["department", "departmentname", "team", "category", "jobcategory", "job_category",
                  "function", "recruitcategoryname", "posttypename", "posttype"]
SCORE_LINK = ["url", "absolute_url", "job_url", "joburl", "detail_url", "detailurl", "apply_url", "applyurl",
              "path", "slug"]
SCORE_JD = ["description", "overview", "responsibility", "responsibilities", "requirement", "requirements",
            "qualification", "qualifications", "jobdescription", "job_description"]
SCORE_REFERENCE = ["code", "key", "value", "label", "dictcode", "dict_code", "optioncode", "option_code",
                   "enum", "enumcode", "enum_code", "categorycode", "category_code", "parentcode",
                   "parent_code", "parentid", "parent_id", "children", "childlist", "displayorder",
                   "display_order", "sortorder", "sort_order", "level"]
ID_SUFFIXES = ["jobid", "positionid", "postid", "postingid", "requisitionid"]
TITLE_SUFFIXES = ["jobname", "positionname", "postname", "postingname"]
CONTENT_URL = ["news", "announcement", "article"]
NAVIGATION_URL = ["global-header", "global_header", "/navigation", "/nav/", "/menu", "flyout", "/header",
                  "/footer"]
NAVIGATION_KEYS = ["navigation", "nav", "menu", "header", "footer", "flyouts"]
CONFIG_URL = ["config", "settings", "setting"]
CONFIG_KEYS = ["config", "configuration", "settings"]
FACET_URL = ["facet", "facetvalues", "/options/"]
SERVICE_URL = ["locale", "translation", "language", "analytics", "tracking", "collect", "telemetry"]
JOB_META = ["department", "department_id", "deptid", "team", "location", "locations", "city", "cityname",
            "city_info", "worklocation", "requirement", "requirements", "responsibility", "responsibilities",
            "jobdescription", "description", "recruittype", "employment", "job_function", "job_category"]
CONTENT_FIELDS = ["content", "contentshort", "summary", "subtitle", "urlshort", "categoryfullname",
                  "categorycode", "categoryname", "contenttype", "story", "banner", "cooperation"]
PROGRAM_FIELDS = ["targetaudience", "buttons", "sortorder", "programtype", "programstatus"]
PROGRAM_TITLES = ["positionname", "jobname", "postname", "jobtitle"]
NON_JOB_URL = ["/cooperation", "cooperationinfo", "/banner", "/material", "/story", "/news", "/article"]
DICTIONARY_FIELDS = ["pcpath", "mobilepath", "seasontype", "displayorder", "orderval", "hotval", "parentid"]
REGION_FIELDS = ["regioncode", "regionname", "provincename", "provinceid", "citycode", "cityid", "hotcity"]
REGION_URL = ["/region/", "selectallvalidregions", "/province/", "/citylist", "/arealist"]
REGION_EXEMPT = ["requirement", "jobdescription", "positionname", "jobname", "title"]
STRONG_CONTEXT = ["department", "team", "organization", "workplace", "postingdate", "posteddate",
                  "employmenttype", "recruittype"]
DETAIL_URL_TERMS = ["/detail", "/job/", "/jobs/", "/position/", "/post/"]
LOCALE_URL_TERMS = ["/locales/", "/translations/", "/config/"]
ARRAY_ID_KEY = ("(?i)^(id|job_?id|jobid|position_?id|positionid|requisition_?id|requisitionid|post_?id|postid|"
                "posting_?id|uuid)$")
ARRAY_TITLE_KEY = "(?i)^(title|job_?title|jobtitle|position_?name|positionname|name)$"
CONNECTION_SUFFIX = r"(?i)\.(edges|nodes|items|results)$"

# --- secrets ---------------------------------------------------------------------------------
SECRET_WORDS = ["token", "authorization", "cookie", "csrf", "signature", "secret", "session", "key"]
SECRET_KEY_EXTRA = ("(?i)(aes[_-]?iv|necromancer|encrypt|decrypt|cipher|passwd|password|token|secret|session|"
                    "csrf|signature|cookie|auth|api[_-]?key|access[_-]?key|(^|_)key$)")
EPHEMERAL_MARKERS = ["trackid", "trackingid", "traceid", "requestid"]
SECRET_IN_TEXT = r"(?i)(cookie|authorization|token|secret|aes\w*|necromancer)\s*[=:]\s*\S+"
CONTEXT_SECRET = "(?i)aes|necromancer|cookie|authorization|token|secret|key"
PROTECTED_WORDS = ["unauthorized", "forbidden", "no-auth", "illegal-visit", "login required",
                   "authentication required"]
BLOCKED_WORDS = ["captcha", "human verification", "verify you are human", "安全验证", "人机验证", "登录后查看"]
CHALLENGE_WORDS = "(?i)cookie|ssid|challenge|verify"

# --- detail accounting -----------------------------------------------------------------------
DETAIL_BLOCKED = ["BOT_CHALLENGE", "BROWSER_BLOCKED", "JD_CONTAINER_NOT_FOUND", "JD_TOO_SHORT",
                  "PARSE_FAILED", "DETAIL_NAVIGATION_FAILED", "DETAIL_SOURCE_NOT_FOUND"]
DETAIL_FAILED = ["GENERIC_DETAIL_ERROR", "GENERIC_DOM_DETAIL_ERROR", "JD_NOT_FOUND"]
CONTROLLED_LIMITS = ["PAGINATION_LIMIT", "BROWSER_BUDGET_EXHAUSTED"]
STABLE_IDENTITY = ["REQUISITION_ID", "JOB_POSTING_ID", "STABLE_API_ID", "STRUCTURED_DETAIL_ID",
                   "CANONICAL_URL_ID"]
TEASER_FLOOR = 500

# --- links and navigation --------------------------------------------------------------------
LINK_GENERIC_LABELS = ["jobs", "all jobs", "careers", "open positions", "search jobs", "job search",
                       "see details", "read more", "view jobs"]
LINK_NON_JOB = ["privacy", "legal", "talent-community", "talent community", "newsletter", "cookie"]
LINK_JOB_FRAGMENT = "(?i)#/(?:job|jobs)/[0-9a-z][0-9a-z-]{3,}"
LINK_SEARCH_PATH = "(?i)/(?:searchjobs|job-search|search-results)(?:/|$)"
LINK_LANDING_PATH = "(?i)^/(?:[a-z]{2}(?:-[a-z]{2})?/)?(?:jobs|positions|careers|openings)?/?$"
LINK_IDENTITY_PATH = ("(?i)(?:/details?/|/job/|/jobs/|/position/|/positions/|/opening/).*"
                      "(?:[0-9]{3,}|[0-9a-f]{8}-[0-9a-f-]{27,}|jid-)")
CARD_CONTROL_WORDS = ["locationpicker", "location picker", "filter", "support", "apply", "login", "sign in",
                      "privacy", "cookie", "pagination", "locale"]
CARD_JOB_PATH = (r"(?i)(/details?/|/job/|/jobs/|/position/|/opening/|jid-|[/-]\d{3,}(?:/|$)|"
                 "#/(?:job|jobs)/[0-9a-z-]{4,})")
ENTRY_TERMS = {
    "CAMPUS": ["校园招聘", "校招", "campus"],
    "SOCIAL": ["社会招聘", "社招", "social", "experienced"],
    "INTERN": ["实习招聘", "实习生", "实习", "intern"],
    "OVERSEAS": ["海外招聘", "海外职位", "overseas"],
    "ALL_JOBS": ["招聘职位", "职位列表", "岗位列表", "职位机会", "岗位机会", "查看职位", "全部职位", "搜索职位",
                 "all jobs", "job opportunities"],
}
ENTRY_NEGATIVE = ["news", "article", "brand", "privacy", "login", "event", "marketing", "tracking",
                  "analytics", "socialresponsibility", "社会责任", "新闻", "文章", "活动"]
ENTRY_SCORE_POSITIVE = ["校园招聘", "校招", "社会招聘", "社招", "实习", "职位", "岗位", "申请", "查看职位",
                        "职位列表", "全部职位", "jobs"]
ENTRY_SCORE_NEGATIVE = ["新闻", "品牌", "活动介绍", "雇主品牌", "福利介绍", "员工故事", "社会责任", "登录", "隐私"]
ACTION_POSITIVE = ["全部职位", "招聘职位", "职位列表", "查看职位", "在招职位", "岗位", "职位", "jobs", "careers",
                   "recruitment", "campus", "social", "intern"]
ACTION_NEGATIVE = ["esg", "员工发展", "人才理念", "福利", "新闻", "品牌", "隐私", "登录", "活动"]
ROUTE_STRONG = ["全部职位", "职位列表", "岗位列表", "查看职位", "搜索职位", "在招职位", "开放职位", "招聘职位",
                "职位机会", "岗位机会", "全部岗位", "all jobs", "view jobs", "search jobs", "open positions",
                "job list", "open roles"]
ROUTE_SCOPE = ["校园招聘", "校招", "社会招聘", "社招", "实习招聘", "实习生", "应届", "campus", "intern", "social",
               "campus jobs", "internships", "experienced hire"]
ROUTE_BARE = ["职位", "岗位", "jobs", "job", "position", "hiring", "recruit", "招聘", "职位解读"]
ROUTE_NEGATIVE = ["公司介绍", "关于我们", "关于", "企业文化", "了解我们", "招聘流程", "流程", "员工福利", "福利",
                  "新闻", "article", "faq", "常见问题", "联系我们", "联系", "登录", "登 录", "注册", "个人中心",
                  "简历", "宣讲会", "雇主品牌", "雇主", "品牌", "隐私", "下载", "app", "banner", "esg", "员工故事",
                  "人才理念", "文化", "反馈", "帮助", "support", "about us", "about", "company", "our story"]
ROUTE_TERMS = ["career", "careers", "job", "jobs", "position", "positions", "recruit", "recruitment", "campus",
               "social", "trainee", "trainees", "intern", "internship", "internships", "graduate", "graduates",
               "hiring", "talent"]
NON_ROUTE_TERMS = ["about", "news", "article", "product", "products", "home", "privacy", "contact",
                   "marketing", "brand", "brands", "press", "investor", "support"]
JOB_SEARCH_POSITIVE = ["全部职位", "职位列表", "在招职位", "查看职位", "搜索职位", "职位搜索", "校园招聘", "社会招聘",
                       "招聘职位", "职位机会", "岗位投递", "立即投递", "投递职位", "campus jobs",
                       "campus recruitment", "campus", "all jobs", "view jobs", "search jobs", "职位"]
REQUEST_CLASSES = [
    ("TRACKING", ["/pixel/", "/tracking", "/track"]),
    ("TELEMETRY", ["sentry", "telemetry", "monitor", "beacon"]),
    ("ANALYTICS", ["analytics", "pixel", "tracking"]),
    ("TRANSLATION", ["locale", "i18n", "translation"]),
    ("RECRUITMENT_RELEVANT", ["/job", "/jobs", "position", "recruit", "career"]),
    ("MEDIA", [".mp4", ".webm", "image", "font", "video"]),
]
URL_JOB_TERMS = ["job", "jobs", "position", "positions", "career", "careers", "recruit", "recruitment",
                 "hiring", "vacancy", "vacancies", "jobad", "requisition", "joblist", "jobpost", "talent",
                 "职位", "岗位", "招聘"]
URL_CONFIG_TERMS = ["config", "dictionary", "city", "department", "agent", "robot", "portal", "area", "region",
                    "province", "menu", "navigation", "banner", "tenant", "dict", "option", "category",
                    "filter", "setting", "module", "global"]
SOURCE_INTENT = [
    ("CAMPUS", ["/campus", "campus-recruitment", "校园招聘", "校招"]),
    ("SOCIAL", ["/social", "social-recruitment", "社会招聘", "社招"]),
    ("INTERN", ["/intern", "internship", "实习招聘", "实习生"]),
]
FRAME_EXCLUDED = ["doubleclick", "analytics", "tracking", "advert", "youtube", "vimeo"]
PAGINATION_CONTROL = (r"(?i)\b(load more|show more(?: jobs)?|more jobs|next(?: page)?|previous(?: page)?|"
                      r"page\s+\d+|加载更多|下一页|上一页)\b")
TOTAL_PATTERNS = [
    ("SHOWING_RANGE", "HIGH", r"(?i)\bshowing\s+\d+\s*(?:to|[-–—])\s*\d+\s+of\s+(\d[\d,]*)\b"),
    ("NUMBER_THEN_JOB_NOUN", "HIGH",
     r"(?i)\b(\d[\d,]*)\s+(?:open\s+)?(?:jobs?|positions?|openings?|opportunities|results?|职位|岗位|结果)\b"),
    ("JOB_NOUN_THEN_NUMBER", "MEDIUM",
     r"(?i)\b(?:jobs?|positions?|openings?|opportunities|results?|职位|岗位|结果)\s+(?:found\s*)?[:(]?\s*"
     r"(\d[\d,]*)\b"),
    ("FOUND_TOTAL", "HIGH",
     r"(?i)\bfound\s+(\d[\d,]*)\s+(?:jobs?|positions?|openings?|opportunities|results?)\b"),
]
WORK_MODE = r"(?im)^\s*(remote|hybrid|on[- ]?site)\s*$"

# --- detail url evidence ---------------------------------------------------------------------
DETAIL_ID_KEYS = ["postId", "post_id", "jobId", "job_id", "positionId", "position_id", "positionCode",
                  "position_code", "code", "id", "recruitmentId"]
DETAIL_URL_KEYS = ["detailUrl", "detail_url", "jobUrl", "job_url", "url", "applyUrl", "apply_url",
                   "sourceUrl", "source_url", "link", "href", "path"]
DETAIL_FILE_HINTS = ["pb/posDetail.html", "posDetail.html", "pb/positionDetail.html", "positionDetail.html",
                     "jobDetail.html", "jobdetail.html"]
DETAIL_ROUTE_HINTS = ["jobs/detail"]
CARRY_KEYS = ["postType", "post_type", "recruitType", "recruit_type", "type"]
DETAIL_ID_EXCLUDED = "(?i)(^|_)(request|trace|token|nonce|timestamp|seed)($|_)"

# --- company identity ------------------------------------------------------------------------
INFRA_LABELS = ["www", "api", "xg", "m", "mobile", "app", "web", "portal", "careers", "career", "jobs", "job",
                "talent", "recruit", "recruitment", "campus", "hr", "globalhr", "global", "unknown",
                "placeholder", "company", "employer", "official"]
RECRUIT_PLATFORMS = [".mokahr.com", ".feishu.cn", ".zhiye.com", ".beisen.com", ".hotjob.cn", ".iguopin.com"]
HOSTED_PLATFORMS = [".iguopin.com", ".jobs.feishu.cn", ".mokahr.com", ".zhiye.com"]
PLATFORM_TOKENS = ["iguopin", "jobs", "mokahr", "zhiye"]
PROVIDER_HOSTS = {"moka": ".mokahr.com", "zhiye": ".zhiye.com", "feishu": ".jobs.feishu.cn"}
RESERVED_ROOTS = ["example", "test", "invalid", "localhost"]
MULTIPART_TLDS = ["com.cn", "com.hk", "com.tw", "com.au", "com.sg", "co.jp", "co.uk", "co.kr", "org.cn",
                  "net.cn", "gov.cn"]
KNOWN_COMPANIES = {"byd": "比亚迪", "geely": "吉利", "zte": "中兴", "pdd": "拼多多集团", "pinduoduo": "拼多多集团"}
GENERIC_COMPANY = ["all openings", "jobs", "careers", "open positions", "all jobs", "job search",
                   "search jobs"]
TITLE_NOISE = "(?i)(?:招聘|jobs|careers|position|opening|hiring|岗位|职位|官网|人才网)"
TITLE_COMPANY_NOISE = "(?i)(?:招聘|jobs|careers|position|opening|hiring|岗位|职位|官网)"
TITLE_TAIL = r"(?i)(?:\s*(?:人才招聘平台|招聘平台|招聘官网|人才招聘|校园招聘|社会招聘|招聘|jobs|careers))+$"
TITLE_COMPANY_HEAD = r"(?i)^(?:加入|join|jobs?\s+at|careers\s+at|work\s+at|welcome\s+to)\s*"
TITLE_COMPANY_TAIL = r"(?:\s*(?:校园招聘|社会招聘|春季招聘|秋季招聘|夏季招聘|招聘))+$"
TITLE_SEPARATOR = r"\s+[|–—-]\s+"
GENERIC_BRANDS = ["招聘官网", "jobs", "careers"]
NODE_COMPANY_ID = ["company_id", "companyid", "org_id", "orgid"]
NODE_PARENT_ID = ["company_parent_id", "parent_company_id"]
NODE_NAMES = ["short_name", "show_name", "name"]
UNSAFE_NAME = r'[\\/:*?"<>|\r\n\t]+'

# --- error translation -----------------------------------------------------------------------
ERROR_REASONS = {
    "TIMEOUT": "请求超时", "HTTP_401": "登录状态失效或未授权", "HTTP_403": "访问被拒绝",
    "HTTP_404": "页面或接口不存在", "HTTP_400": "该请求被网站拒绝", "HTTP_429": "请求过于频繁",
    "HTTP_5XX": "网站服务器错误", "CONNECTION_ERROR": "网络连接失败", "DETAIL_NOT_FOUND": "未找到岗位详情",
    "PARSING_ERROR": "返回数据无法解析", "RESPONSE_DECODE_ERROR": "响应数据编码无法解析",
    "RESPONSE_NOT_JSON": "返回的数据不是有效 JSON", "HTTP_ERROR": "请求失败",
    "DISCOVERY_FAILED": "未找到可用岗位数据源", "UNSUPPORTED": "暂不支持该网站的自动抓取",
}
ENVIRONMENT_WORDS = ["dns", "network", "browserruntime", "browser_launch", "navigation_timeout",
                     "targetclosed", "connection", "name or service"]

# --- provider mappings -----------------------------------------------------------------------
I18N_KEYS = ["i18n_name", "i18n", "zh_cn", "name", "en_us"]
I18N_FORBIDDEN = ["token", "cookie", "authorization", "signature", "session", "secret", "csrf"]
ALIAS_FIELDS = {
    "job_id": ["Id", "jobAdId", "JobAdId", "jobId", "id", "postId"],
    "job_title": ["JobAdName", "JobName", "jobTitle", "Title"],
    "category": ["Category", "JobCategory", "CategoryName"],
    "category_id": ["CategoryId", "categoryId"],
    "department": ["Org", "Department", "OrgName"],
    "locations": ["LocNames", "Locations", "LocationNames"],
    "education": ["Degree", "Education"],
    "major": ["Major", "Majors"],
    "headcount": ["HeadCount", "RecruitCount"],
    "duty": ["Duty", "Responsibilities", "JobDuty"],
    "requirement": ["Require", "Requirements", "Qualification"],
    "publish_date": ["PostDate", "PublishDate", "CreateDate"],
    "company": ["CompanyName", "Company", "TenantName"],
}
ALIAS_LIST_KEYS = ["Data", "Rows", "Items"]
ALIAS_NESTED_LIST_KEYS = ["Data", "Rows", "Items", "records", "list"]
ALIAS_TOTAL_KEYS = ["Count", "Total", "TotalCount", "totalCount"]
CATEGORY_LABELS = {"1": "社会招聘", "2": "校园招聘", "3": "实习招聘"}
CATEGORY_SEGMENTS = {"1": "social", "2": "campus", "3": "intern"}
BUSINESS_TYPES = {"social": "1", "campus": "2", "intern": "3"}
ENVELOPE_ROUTES = ["campus-recruitment", "social-recruitment", "campus_apply"]
WINDOW_STATES = ["__INITIAL_DATA__", "__INITIAL_STATE__", "__INITIAL_PROPS__", "__NUXT__"]

# --- export ----------------------------------------------------------------------------------
CSV_HEADERS = ["id", "title", "company", "location", "department", "education", "job_type", "publish_date",
               "responsibilities", "requirements", "detail_url", "apply_url", "jd_enrichment_status"]
SHEET_HEADERS = ["序号", "公司", "岗位名称", "Job ID", "招聘类型", "岗位类别", "部门", "工作地点", "学历", "专业",
                 "招聘人数", "发布时间", "岗位职责", "任职要求", "完整 JD", "Detail URL", "Apply URL", "Source URL",
                 "数据完整性", "JD 获取状态"]
CELL_LIMIT = 32767
CELL_MARKER = "...[TRUNCATED]"
LONG_CELL_MARKER = "\n[EXCEL_CELL_TRUNCATED — full content is available in jobs.json]"
# spelled out: a class of single characters is one table look-up, ranges are compared one after the other
ILLEGAL_CONTROL = "[" + "".join(rf"\x{i:02x}" for i in [*range(32), 127] if i not in (9, 10, 13)) + "]"
FORMULA_START = "^[=+@-]"

# --- timing ----------------------------------------------------------------------------------
REUSE_SECONDS = 86400
QUIET_MS, MIN_OBSERVE_MS, MAX_OBSERVE_MS = 1500, 2500, 12000
ETA_SAMPLES, ETA_MIN_SAMPLES, ETA_MIN_SPAN, ETA_STALL = 12, 5, 10.0, 15.0

# whitespace a text trim removes, as characters and as a regex class
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


# Named character references, those of Latin-1 in the order of their code points from 160 on, then some others.
LATIN_ENTITIES = """nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute micro
para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute
Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times Oslash Ugrave Uacute Ucirc Uuml Yacute THORN
szlig agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml eth ntilde ograve oacute
ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml""".split()
ENTITIES = {name: chr(160 + i) for i, name in enumerate(LATIN_ENTITIES)} | {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ensp": "\u2002", "emsp": "\u2003", "thinsp": "\u2009", "zwnj": "\u200c",
    "zwj": "\u200d", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019", "sbquo": "\u201a", "ldquo": "\u201c",
    "rdquo": "\u201d", "bdquo": "\u201e", "bull": "\u2022", "hellip": "\u2026", "permil": "\u2030", "lsaquo": "\u2039", "rsaquo": "\u203a",
    "euro": "\u20ac", "trade": "\u2122", "larr": "\u2190", "rarr": "\u2192", "minus": "\u2212", "oelig": "\u0153", "OElig": "\u0152",
}

# The two server-rendered templates of the CMS provider (paths, labels, error codes)
CMS_TOTAL = r"共\s*(\d+)\s*条记录"
CMS_LINK = r"^/zpdetail/(\d+)(?:\?[^#]*)?$"
CMS_SECOND_MARKS = ["/Campuslist", "jobList"]
CMS_SECOND_LINK = r"^/xiangqing\?jobId=(\d+)"
CMS_SECOND_PAGE = r"(?i)[?&]PageIndex=(\d+)"
CMS_ERRORS = {"total": "LIST_TOTAL_MISSING", "links": "LIST_JOB_LINKS_MISSING",
              "second_pages": "KUNLUNXIN_PAGE_COUNT_MISSING", "second_links": "KUNLUNXIN_JOB_LINKS_MISSING"}
CMS_DETAIL = {
    "job_title": [r"""<h1[^>]*id=["']detial_title["'][^>]*>(.*?)</h1>""", r"""<div\s+class=["']title["'][^>]*>.*?<h3>(.*?)</h3>"""],
    "location": [r"工作地点：?</label>\s*<div[^>]*>(.*?)</div>"],
    "department": [r"需求部门：?</label>\s*<div[^>]*>(.*?)</div>"],
    "responsibilities": [r"工作职责：?</h3>\s*<pre[^>]*>(.*?)</pre>", r"<h4>\s*工作职责[:：]\s*</h4>\s*<p[^>]*>(.*?)</p>"],
    "requirements": [r"任职资格：?</h3>\s*<pre[^>]*>(.*?)</pre>", r"<h4>\s*任职要求[:：]\s*</h4>\s*<p[^>]*>(.*?)</p>"],
    "headcount": [r"招聘人数：\s*(.*?)</div>"],
    "publish_date": [r"发布时间：\s*(.*?)</div>", r"""<div\s+class=["']time["'][^>]*>\s*发布时间[:：]\s*(.*?)</div>"""],
    "deadline": [r"截止时间：\s*(.*?)</div>"],
}
CMS_TAGS = r"""<div\s+class=["']sx["'][^>]*>(.*?)</div>"""
CMS_APPLY_ATTRIBUTE = "nexturl"

# Provider -> (priority, hosts, marks its entrance page must show)
ADAPTERS = {
    "beisen_cms": (9, ("zhiye.com",), ("stc-cms.beisen.com/CmsPortal/",)),
    "zhiye": (10, ("zhiye.com",), ()),
    "moka": (20, ("mokahr.com",), ()),
    "feishu": (30, ("jobs.feishu.cn",), ()),
}
