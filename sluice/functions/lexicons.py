"""Lexicons that rules take as parameters. Fixed values, in their natural order; each may be replaced by a caller's own."""

#: Strings of questions that carry no content.
QUESTION_STOPS = ("请问", "如何", "怎么", "怎样", "什么", "哪些", "是否", "能否", "可以", "需要", "有关", "相关")

#: How a question asks for an attribute.
ASKED = {
    "DEADLINE": ("截止(?:日期|时间)?", "期限", "最晚"),
    "TIME": ("开放时间", "办理时间", "服务时间", "什么时候", "何时", "几点", "时段", "时间"),
    "LOCATION": ("地点", "地址", "在哪里", "哪儿", "位置"),
    "PRICE": ("价格", "金额", "费用", "收费", "多少钱", "是否免费"),
    "ELIGIBILITY": ("资格", "条件", "谁可以", "能否申请", "符合什么"),
    "PROCEDURE": ("流程", "步骤", "怎么办理", "如何办理", "手续"),
    "ENTRY": ("入口", "链接", "网址", "在哪申请", "申请平台", "办理平台"),
    "MATERIALS": ("材料", "证件", "需带", "提交什么", "准备什么"),
    "CONTACT": ("联系方式", "联系电话", "电话", "邮箱", "怎么联系"),
    "OBJECT": ("适用对象", "面向谁", "服务对象", "对象"),
    "CURRENT_STATUS": ("目前", "当前", "现在", "最新", "今年"),
}

#: How evidence shows an attribute.
SHOWN = {
    "DEADLINE": ("截止", "期限", "最晚", r"20\d{2}[年/-]\d{1,2}"),
    "TIME": ("时间", "开放", "工作日", "周[一二三四五六日]", r"\d{1,2}[:：]\d{2}"),
    "LOCATION": ("地点", "地址", "位于", "大楼", "室", "校区"),
    "PRICE": ("费用", "收费", "免费", r"\d+(?:\.\d+)?\s*(?:元|人民币)"),
    "ELIGIBILITY": ("资格", "条件", "申请人", "可申请", "符合", "对象"),
    "PROCEDURE": ("流程", "步骤", "办理", "申请", "提交", "登录"),
    "ENTRY": ("入口", "链接", "网址", "平台", "系统", "登录", "https?://"),
    "MATERIALS": ("材料", "证件", "身份证", "学生证", "申请表", "提交"),
    "CONTACT": ("联系", "电话", "邮箱", r"\d{3,4}[- ]?\d{6,8}", r"[\w.+-]+@[\w.-]+"),
    "OBJECT": ("对象", "面向", "申请人", "学生", "教师", "校友", "职工"),
    "CURRENT_STATUS": ("目前", "当前", "现行", "最新"),
}

#: The values of the attributes whose values can conflict.
VALUES = {
    "DEADLINE": r"20\d{2}[年/-]\d{1,2}(?:[月/-]\d{1,2}日?)?",
    "TIME": r"\d{1,2}[:：]\d{2}(?:\s*[-–—至]\s*\d{1,2}[:：]\d{2})?",
    "PRICE": r"\d+(?:\.\d+)?\s*(?:元|人民币)",
    "CONTACT": r"(?:\d{3,4}[- ]?)?\d{6,8}|[\w.+-]+@[\w.-]+",
}

#: Kinds of content by what title and text say, the first that holds; and audiences.
CONTENT_KINDS = (("policy", "办法|规定|条例|细则|制度|章程|管理规则"), ("procedure_guide", "(?i)办理|办事|申请|流程|步骤|指南|须知|材料|入口|常见问题|FAQ"), ("notice", "通知|公告|公示"), ("faq", "(?i)问答|常见问题|FAQ"))
AUDIENCES = (("本科生", "本科生"), ("研究生", "研究生"), ("博士生", "博士生"), ("国际学生", "国际学生"), ("新生", "新生"), ("毕业生", "毕业生"), ("教师", "教职工"), ("教职工", "教职工"))
EVERYONE = "全校学生"

#: Topics by their markers, in the order in which they are named.
TOPICS = {
    "教务": ("教务", "学籍", "选课", "培养方案", "转系", "转专业", "辅修", "课程", "考试", "成绩", "学位"),
    "学生事务": ("学生事务", "学生手册", "奖学金", "助学金", "资助", "勤工助学", "学生工作", "评优", "社团"),
    "校园生活": ("宿舍", "住宿", "食堂", "餐饮", "校园卡", "校车", "交通", "图书馆", "借阅", "校医院", "就医", "校园网", "vpn", "体育馆", "场馆"),
    "科研实践": ("科研", "科研实践", "实验室", "项目申报", "学术研究", "伦理审查", "知识产权", "srt"),
    "国际交流": ("国际交流", "交换", "访学", "签证", "出国", "留学", "国际学生", "港澳台"),
    "就业": ("就业", "招聘", "生涯", "职业发展", "三方协议", "就业手续", "毕业去向", "档案", "户口"),
    "新生": ("新生", "入学报到", "迎新", "预报到"),
    "毕业": ("毕业", "离校", "学位证", "毕业证", "毕业生"),
}
#: Departments that titles name.
TITLE_DEPARTMENTS = (("教务", "教务处"), ("研究生院", "研究生院"), ("学生社区", "学生社区管理服务中心"), ("校医院", "校医院"), ("图书馆", "图书馆"), ("科研", "科研院"), ("就业", "学生职业发展指导中心"), ("国际", "国际合作与交流处"))

#: What a private page is told by: its URL, words of its URL, link or title, and values in its text.
PRIVATE_URL = r"(?:^|[/_.-])(?:my|myhome|personal|usercenter)(?:[/_.-]|$)"
PRIVATE_WORDS = ("我的", "个人", "成绩", "gpa", "课表", "选课结果", "考试安排", "余额", "消费", "财务", "工资", "借阅记录", "申请状态", "个人中心", "账号设置", "个人信息", "身份证", "银行卡", "医疗记录", "体检结果", "我的申请", "我的账户", "我的借阅")
PRIVATE_VALUES = (
    r"身份证(?:号|号码)?\s*[：:]?\s*\d{15,18}[0-9Xx]",
    r"银行卡(?:号|号码)?\s*[：:]?\s*\d{12,19}",
    r"(?:校园卡余额|账户余额|GPA|平均绩点)\s*[：:]?\s*\d",
    r"(?:我的成绩|我的课表|我的申请|我的审批|我的借阅|我的账户)",
    r"(?s)姓名\s*[：:]\s*[^\s]{2,8}.{0,120}学号\s*[：:]\s*\d{6,15}",
    r"(?s)(?:手机号名单|联系电话名单|学生名单|人员名单).{0,200}1[3-9]\d{9}",
    r"(?:个人医疗记录|个人体检结果|个人消费记录|个人缴费记录|个人工资|个人住宿房间)",
)

#: Evidence is of the question's subject if it names it too; a lost or renewed card must stand near what is done about it.
SUBJECTS = ((("校园卡", "一卡通", "校园码"), ("校园卡", "一卡通", "校园码")), (("奖学金", "助学金", "资助"), ("奖学金", "助学金", "资助")), (("转系", "转专业"), ("转系", "转专业")), (("宿舍", "住宿"), ("宿舍", "住宿", "公寓")), (("交换", "联合培养"), ("交换", "联合培养")), (("毕业", "离校"), ("毕业", "离校")))
TITLE_AUDIENCES = ("本科生", "研究生", "国际学生", "教职工")
NEARNESS = {"asked": ("丢", "挂失", "补办", "补卡", "更换"), "subjects": ("校园卡", "一卡通", "校园码"), "actions": ("丢失", "遗失", "挂失", "补办", "补卡", "办理新卡"), "within": 120}

#: What the standing and the time of a source count for in reranking.
AUTHORITY = {"official_internal": 1.0, "official": 1.0, "authoritative_external": 0.72, "unverified": 0.2}
RECENCY = {"active": 1.0, "unknown": 0.62, "upcoming": 0.45, "expired": 0.1}
