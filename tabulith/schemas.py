"""Record types of the engine's tables, as DDL."""

EVIDENCES = (
    "text_sha1 string, text_highlited string, text string, header string, cell_type string, cell_content string, cell_reference string,"
    " cell_layout string, cell_styles boolean, this_paper boolean, row int, col int, row_context string, col_context string, ext_id string")
PROPOSALS = (
    "cell_ext_id string, dataset string, metric string, task string, format string, raw_value string, model string, model_type string,"
    " confidence double, parsed double, struct_model_type string, struct_dataset string")
GOLD = ("cell_ext_id string, task string, dataset string, metric string, format string, model string, model_type string, raw_value string, parsed double")
RESULTS = ("dataset string, metric string, task string, model string, score double")
PAPERS_CSV = ("arxiv_id string, archive_size long, sha256 string, title string, status string, sections int, tables int")
_RECORD = "struct<task:string,dataset:string,metric:string,value:string,model:string,row:int,column:int>"
SEGMENTED_TABLES = (
    "arxiv_id string, sha256 string, fold string, tables array<struct<index:int,leaderboard:boolean,ablation:boolean,dataset_text:string,"
    f"segmentation:array<array<string>>,records:array<{_RECORD}>>>")
METRICS = ("task string, dataset string, metric string, higher_is_better boolean, `range` string")
TAXONOMY = ("task string, dataset string, metric string")
TABLE_METADATA = ("filename string, layout string, caption string, figure_id string")
PAPER_TEXT = ("title string, authors string, abstract string, fragments array<struct<paper_id:string,`order`:int,header:string,text:string>>")
FRAGMENTS = ("paper_id string, `order` int, header string, text string")
CELLS = ("paper_id string, table_name string, row int, col int, raw_value string, value string, refs array<string>, layout string")
GRAPHQL_DUMP = (
    "data struct<allPapers:struct<edges:array<struct<node:struct<arxivId:string,goldTags:string,tableSet:struct<edges:array<struct<node:struct<"
    "name:string,datasetText:string,notes:string,goldTags:string,matrixGoldTags:array<array<string>>,cellsSotaRecords:string,parser:string>>>>>>>>>")
