"""Word lists and pattern tables of the extraction rules."""

# Names, words and patterns that results depend on.

ENTITY_TYPES = ("人名", "地名", "组织名", "时间", "产品名", "职位", "事件", "作品名", "化学式")

MODEL_LABELS = {
    "PERSON": "人名", "LOC": "地名", "GPE": "地名", "ORG": "组织名", "PRODUCT": "产品名", "EVENT": "事件",
    "DATE": "时间", "TIME": "时间", "FAC": "地名", "NORP": "组织名", "WORK_OF_ART": "作品名",
}
TIME_LABELS = ("DATE", "TIME", "CARDINAL", "ORDINAL")
PLACE_LABELS = ("GPE", "LOC", "FAC")

#: Relations that a pair of types allows.
TYPE_COMPAT = {
    ("人名", "组织名"): ("任职", "创建", "担任", "属于", "管理"),
    ("人名", "职位"): ("任职", "担任"),
    ("人名", "人名"): ("管理",),
    ("组织名", "人名"): (),
    ("组织名", "组织名"): ("包含", "属于", "合作", "投资", "收购", "管理"),
    ("组织名", "地名"): ("位于",),
    ("组织名", "产品名"): ("研发", "生产", "包含"),
    ("组织名", "时间"): ("成立",),
    ("人名", "时间"): ("成立",),
    ("地名", "组织名"): ("位于",),
    ("地名", "地名"): ("位于",),
    ("职位", "组织名"): ("任职",),
    ("人名", "产品名"): ("研发", "发明", "创建"),
    ("人名", "作品名"): ("创建",),
    ("作品名", "人名"): ("创建",),
}

#: Clause rules: relation, reversed, longest left name, words between, longest right name, words after it.
CLAUSE_RULES = (
    ("任职", False, 8, "担任", 10, ""),
    ("位于", False, 15, "总部位于", 15, "$"), ("位于", False, 15, "坐落于", 15, "$"), ("位于", False, 8, "是", 8, "的首都"), ("位于", False, 8, "是", 8, "的省会"),
    ("研发", False, 15, "研发了", 15, "$"), ("研发", False, 15, "开发了", 15, "$"), ("研发", False, 15, "推出了", 15, "$"),
    ("合作", False, 15, "与", 15, "合作"), ("合作", False, 15, "和", 15, "联合"),
    ("成立", False, 15, "成立于", 15, "$"), ("成立", False, 15, "创立于", 15, "$"),
    ("属于", False, 15, "属于", 15, "$"), ("属于", False, 15, "隶属于", 15, "$"),
    ("投资", False, 15, "投资了", 15, "$"),
    ("创建", False, 8, "创立了", 15, "$"), ("创建", False, 8, "创办了", 15, "$"), ("创建", False, 8, "创建了", 15, "$"), ("创建", False, 8, "建立", 15, "$"),
    ("创建", True, 15, "由", 8, "创立$"), ("创建", True, 15, "由", 8, "创办$"), ("创建", True, 15, "由", 8, "创建$"),
    ("发明", False, 8, "发明了", 15, "$"),
    ("著有", False, 8, "著有《", 20, "》"), ("著有", False, 8, "撰写了《", 20, "》"), ("著有", False, 8, "编纂了《", 20, "》"),
    ("发现", False, 8, "发现了", 15, "$"),
    ("组成", False, 15, "由", 15, "组成"),
    ("生产", False, 15, "生产", 15, "$"), ("生产", False, 15, "制造", 15, "$"),
    ("收购", False, 15, "收购了", 15, "$"),
)

#: Rules with three names: person, organisation, post.
POST_RULES = ("担任", "出任")

#: Literal templates: pattern, relation, reversed.
CLAUSE_TEMPLATES = (
    ("{entity1}是{entity2}的创始人", "创建", False), ("{entity1}总部位于{entity2}", "位于", False), ("{entity1}研发了{entity2}", "研发", False),
    ("{entity1}开发了{entity2}", "研发", False), ("{entity1}推出了{entity2}", "研发", False), ("{entity1}与{entity2}合作", "合作", False),
    ("{entity1}成立于{entity2}", "成立", False), ("{entity1}属于{entity2}", "属于", False), ("{entity1}投资了{entity2}", "投资", False),
    ("{entity1}收购了{entity2}", "收购", False), ("{entity1}生产{entity2}", "生产", False), ("{entity1}担任{entity2}", "任职", False),
    ("{entity1}创立了{entity2}", "创建", False), ("{entity1}创办了{entity2}", "创建", False), ("{entity1}创建了{entity2}", "创建", False),
    ("{entity1}由{entity2}创立", "创建", True), ("{entity1}由{entity2}创办", "创建", True), ("{entity1}由{entity2}创建", "创建", True),
    ("{entity1}发明了{entity2}", "发明", False), ("{entity1}发现了{entity2}", "发现", False), ("{entity1}著有《{entity2}》", "著有", False),
    ("{entity1}是{entity2}的首都", "位于", False), ("{entity1}是{entity2}的省会", "位于", False),
    ("{entity1}是{entity2}的代表人物", "关联", False), ("{entity1}是{entity2}的代表作", "代表作", False),
)

#: Words between two mentions and their relation, in the order in which they are tried.
BETWEEN_WORDS = (
    ("位于", "总部位于|坐落于|地处|坐落|位于"),
    ("创建", "创立了|创办了|创建了|成立了|建立了|组建了|创立|创办|创建|成立|建立|组建"),
    ("任职", "担任了|出任了|就任了|担任|出任|就任"),
    ("研发", "研发了|开发了|研制了|推出了|研发|开发|研制|推出"),
    ("投资", "投资了|注资了|入股了|投资|注资|入股"),
    ("收购", "收购了|并购了|兼并了|收购|并购|兼并"),
    ("合作", "合作了|联合了|携手了|合作|联合|携手"),
    ("生产", "生产了|制造了|生产|制造"),
    ("发明", "发明了|发明出|发明"),
    ("发现", "发现了|发现"),
    ("属于", "隶属于|属于|归属"),
    ("包含", "包含|包括|拥有|设有|下辖"),
    ("管理", "负责管理|负责|管理|管辖"),
)

#: Typed templates for two mentions: words of which one has to stand between, relation, types (None: any).
PAIR_TEMPLATES = (
    (("隶属于",), "属于", "人名", "组织名"), (("属于",), "属于", None, None), (("所属部门是",), "属于", "人名", "组织名"),
    (("在", "担任"), "任职", "人名", "组织名"), (("负责",), "管理", None, None), (("负责管理",), "管理", None, None), (("管理",), "管理", None, None),
    (("包含",), "包含", "组织名", "组织名"), (("设有",), "包含", "组织名", "组织名"), (("下辖",), "包含", "组织名", "组织名"),
    (("由", "担任"), "任职", "职位", "人名"), (("由", "负责"), "管理", "组织名", "人名"), (("负责",), "管理", "人名", "组织名"), (("负责",), "管理", "组织名", "人名"),
    (("总部位于",), "位于", "组织名", "地名"), (("由", "创立"), "创建", "组织名", "人名"), (("由", "创建"), "创建", "组织名", "人名"),
    (("研发了",), "研发", "组织名", "产品名"), (("推出了",), "研发", "组织名", "产品名"), (("开发了",), "研发", "组织名", "产品名"),
    (("投资了",), "投资", "组织名", "组织名"), (("收购了",), "收购", "组织名", "组织名"), (("位于",), "位于", None, "地名"),
    (("担任",), "任职", "人名", "职位"), (("创立于",), "成立", "组织名", "时间"), (("成立于",), "成立", "组织名", "时间"), (("创建于",), "成立", "组织名", "时间"),
)

#: Typed templates for three mentions, of which the third only has to be there.
TRIPLE_TEMPLATES = (
    ("{e1}在{e2}担任{e3}", "任职", "人名", "组织名", "职位"), ("{e1}是{e2}的{e3}", "任职", "人名", "组织名", "职位"),
    ("{e1}由{e2}于{e3}创立", "创建", "组织名", "人名", "时间"), ("{e1}担任{e2}的{e3}", "任职", "人名", "组织名", "职位"),
)

VERB_RELATIONS = {
    "创立": "创建", "创办": "创建", "创建": "创建", "成立": "成立", "建立": "创建", "组建": "创建", "位于": "位于", "坐落": "位于",
    "担任": "任职", "出任": "任职", "就任": "任职", "任职": "任职", "研发": "研发", "开发": "研发", "研制": "研发", "推出": "研发",
    "投资": "投资", "注资": "投资", "收购": "收购", "并购": "收购", "兼并": "收购", "合作": "合作", "联合": "合作", "配合": "合作",
    "生产": "生产", "制造": "生产", "加工": "生产", "发明": "发明", "发明出": "发明", "发现": "发现", "发现出": "发现", "属于": "属于", "隶属": "属于",
    "包含": "包含", "包括": "包含", "设有": "包含", "拥有": "包含", "下辖": "包含", "管理": "管理", "负责": "管理", "管辖": "管理", "负责管理": "管理",
    "主编": "创建", "开发出": "研发", "创作": "创建", "发表": "创建", "撰写": "创建",
}

SUBJECT_VERBS = ("是", "有", "在", "位于", "担任", "总部", "研发", "开发", "推出", "生产", "投资", "收购", "创立", "创办", "创建", "成立", "属于", "隶属", "合作", "联合")
CARRY_WORDS = ("还", "也", "又", "更", "并", "且", "同时", "此外", "另外", "而且", "并且", "依然", "仍然", "已", "曾", "正", "将", "会", "一直", "始终")

PREFIX_NOISE = "由被将从在对于以和与及跟向从到往经过通过按照根据还也又更了着过"
SUFFIX_NOISE = "不仅|不但|不光|不单|而且|并且|同时|此外|另外|依然|仍然|正在|已经|曾经|将要|将会|一直|始终|总部|展开|[还也又更并且]"
TAIL_NOISE = "等|展开|起来|下来|上去|出来"
FIELD_WORDS = "领域|方面|行业|产业|市场"
COMPANY_SUFFIXES = ("有限公司", "集团有限公司", "股份有限公司", "有限责任公司", "集团", "公司")
TRADE_SUFFIXES = ("技术", "科技")
MENTION_EDGES = ("隶", "隶于", "属于", "包", "包括", "拥有", "设", "设有", "下辖", "负责", "管理", "担任", "的", "着", "于", "在")
UNIT_ENDINGS = ("部", "组", "组)", "中心", "处", "室", "科", "所", "院", "会")
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
ORG_SUFFIXES = ("公司", "集团", "企业", "银行", "大学", "学院", "医院", "部门", "研究所", "研究院", "中心", "基金", "协会")

GENERIC_ENTITIES = (
    "公司", "总部", "组织", "机构", "企业", "集团", "部门", "单位", "信息", "技术", "科技", "科学", "工程", "产业", "行业", "领域", "工业", "农业", "商业", "服务业", "制造业", "系统", "平台", "产品",
    "服务", "方案", "项目", "方面", "方式", "方法", "手段", "途径", "渠道", "问题", "情况", "现象", "过程", "结果", "影响", "条件", "因素", "特点", "优势", "功能", "特性", "世纪", "年代", "时期",
    "阶段", "时代", "一生", "展开", "起来", "下来", "上去", "出来", "分泌", "免疫", "内分泌", "极速版", "火山版", "常用于化工", "常用于工业", "常用于", "三角洲", "盆地", "平原", "高原", "山脉", "沙漠",
    "雨林", "北部", "南部", "东部", "西部", "中部", "东南部", "西北部", "交界处", "边境", "南北方", "电路板", "电镀", "镀锌", "玻璃", "印刷电路板", "最后", "基础", "等领域", "等方面", "社交", "软件",
    "食品", "加工", "合金", "电池", "钢铁", "不锈钢", "镁合金", "融雪剂", "试剂", "短视", "频平台", "轻量化", "电商", "外卖", "生活", "视频", "作曲家", "首都", "代表作可用于", "期间", "发明", "专利",
    "创始人", "场所", "元素", "硬盘", "键盘", "鼠标", "显示器", "打印机", "为清朝的", "奠定了基础", "常用于玻璃", "食品加工", "色列", "信念", "世界观", "个性", "心理", "特征", "能力", "气质", "性格", "态度",
    "部件", "名称", "传递", "文艺", "发展", "关系", "总和", "上层", "建筑", "阶级", "意识", "形态", "制度", "地位", "社会", "传承", "文化", "要素", "认知", "倾向性", "需要", "动机", "兴趣", "理想",
    "感觉", "知觉", "记忆", "思维", "想象", "定律", "矛盾", "群众", "人们", "资料", "所有制", "形式", "分配", "城市", "分区", "商业区", "住宅区", "工业区", "行政区", "文化区", "研究", "研究法", "研究人",
    "法学", "宪法", "教育学", "心理学", "主要从事非农业", "济各部门提供物质技术基础的主要", "阶级是指在", "生产关系是人们在物质", "济基础是指由社会一定发展阶段的", "活动", "模式", "增长", "标志", "比重", "总人口", "亚热带季",
    "温带季", "海洋性", "朗玛峰",
)

#: Nouns that are no names; another list is a parameter of the mention operators and of svo_relations.
GENERIC_NOUNS = (
    "所有", "日常", "工作", "整体", "业务", "事务", "服务", "售后", "前端", "后端", "软件", "硬件", "测试", "开发", "运营", "管理", "采购", "绩效", "薪酬", "核算", "招聘", "考勤", "请假", "加班",
    "报销", "保密", "出差", "办公", "会议室", "印章", "档案", "安全", "网络", "培训", "平面", "视频", "运动", "休闲", "养生", "健身", "兼职", "编程", "剪辑", "口译", "笔译", "客服", "营销", "销售",
    "上传", "下单", "生产", "安装", "维修", "装备", "钢带", "管材", "薄板", "炼钢", "涂装", "润滑", "夹具", "模具", "量具", "图纸", "会计", "出纳", "法务", "法律", "税务", "审计", "文案", "设计",
    "推广", "媒体", "广告", "活动", "方案", "流程", "制度", "规范", "条例", "办法", "计划", "进度", "预算", "成本", "报价", "合同", "发票", "单据", "凭证", "台账", "资产", "设备", "设施", "办公用品",
    "办公设备", "监控设备", "网络设备", "空调设备", "状态", "资料", "文件", "文档", "数据", "信息", "通知", "公告", "申请", "审批", "审核", "核准", "批准", "检验", "验收", "验收单", "入库", "出库", "领用",
    "借用", "归还", "报修", "报废", "客户", "供应", "合作", "资源", "成果", "表", "单", "并发", "实时", "期末", "工种", "工序", "工位", "项目", "上下", "正式", "标准", "内件", "拆", "框", "员工",
    "主任", "主管", "总监", "经理", "部长", "总裁", "应聘", "对象", "平台", "区域", "方面", "部分", "高精密", "精细", "高度", "突发", "附加", "特殊", "总部", "旗下", "费用", "产品", "部门", "中心",
    "催收", "奋进", "团结", "创新", "务实", "效益", "质量", "保障", "文化", "愿景", "使命", "目标", "诚信", "责任", "担当", "防控", "管控", "合规", "检查", "监督", "机制", "体系", "能力", "水平",
    "素质", "意识", "效率", "执行力", "演示文稿", "幻灯片", "日报", "周报", "月报", "年报", "产品线", "版本", "行业", "领域", "系统", "等级", "规格", "类型", "组装", "包装", "检测", "存储", "余额",
    "往来", "计提", "折旧", "摊销", "税费", "付款", "收款", "结算", "汇款", "退款", "充值", "请假条", "加班单", "出差单", "报销单", "采购单", "订单", "入库单", "出库单", "退货", "索赔", "投诉", "议案",
    "题案", "议题", "纪要", "决议", "结论", "辅导", "带教", "实习", "试用", "转正", "晋升", "调岗", "调薪", "降职", "免职", "辞退", "裁员", "入职", "离职", "调休", "社保", "公积金", "五险一金", "一金",
    "节日", "福利", "团队", "建设", "拓展", "实施", "执行", "优化", "改进", "升级", "完善", "晚餐", "餐费", "交通", "住宿", "办公区", "办公区域", "用品", "场所", "需求", "分析",
)

#: Relation checks as data: relation, first names, second names (empty: any) that are no facts together.
NO_FACTS = (
    ("生产", ("玻璃", "电镀", "镀锌", "电路板", "常用于化工", "常用于工业", "工业", "农业", "常用于", "印刷电路板", "代表作可用于"), ()),
    ("位于", ("中国", "上海", "北京"), ("尼泊尔", "印度", "老挝", "三角洲", "杭州")),
    ("位于", ("欧洲", "美洲", "亚洲"), ("大洋洲", "非洲", "亚洲", "欧洲", "美洲")),
    ("位于", ("巴赫", "西藏"), ()),
    ("创建", (), ("计算机", "唐代", "宋代", "明代", "清代", "俄国", "苏联", "奥地利", "意大利", "中国", "美国电动汽车", "文艺", "宋代女", "行吟")),
    ("创建", ("场所", "化学式", "骨组织", "外卖", "世民", "祖朱", "元璋", "清太", "祖努尔"), ()),
    ("发明", (), ("发明",)),
)
