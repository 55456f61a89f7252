"""Canonical schemas. Offsets are 0-based, half-open and in code points."""

from __future__ import annotations

ENTITY = (
    "struct<start:int,end:int,label:string,text:string,start_char:int,end_char:int,context_pre:string,context_post:string,"
    "alt_text:string,alt_start_char:int,alt_end_char:int,subclass:array<string>,method:string,score:double>"
)
ENTITIES = f"array<{ENTITY}>"
DOCUMENTS = "doc_id long, path string, extension string, text string"
PARAGRAPHS = "doc_id long, para_idx int, text string, paragraph_id string, n_chars int, n_tokens int"
TOKENS = "doc_id long, para_idx int, tok_idx int, token string, label string"
SAMPLES = "n_labels int, tokens array<string>, tags array<int>, hash string, original_hash string"
BLOCKS = "doc_id long, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string"
ALIGNMENT = "pair_id long, pos int, source string, target string"
#: Tables of the store. Fixed values.
STORE = {
    "anonymization_document": "id string, created_at timestamp, updated_at timestamp, name string",
    "anonymization_paragraph": "id string, created_at timestamp, updated_at timestamp, text string, prediction string, validation string",
    "anonymization_document_paragraph": "id string, document_id string, paragraph_id string, `order` int",
    "datapublic_document": "id string, created_at timestamp, updated_at timestamp, prediction string, validation string",
    "datapublic_paragraph": "id string, created_at timestamp, updated_at timestamp, text string, prediction string, validation string",
    "datapublic_document_paragraph": "id string, document_id string, paragraph_id string, `order` int",
}

#: Columns of the public dataset: 35 strings, one int and nine booleans. Fixed values.
PUBLIC_FIELDS = {
    "nro_registro": "string", "tomo": "int", "date": "string", "n_expte_eje": "string", "firma": "string", "materia": "string", "art_infringido": "string",
    "codigo_o_ley": "string", "conducta": "string", "conducta_descripcion": "string", "violencia_de_genero": "boolean", "v_fisica": "boolean", "v_psic": "boolean",
    "v_econ": "boolean", "v_sex": "boolean", "v_soc": "boolean", "v_amb": "boolean", "v_simb": "boolean", "v_polit": "boolean", "modalidad_de_la_violencia": "string",
    "frases_agresion": "string", "genero_acusado/a": "string", "persona_acusada_no_determinada": "string", "nacionalidad_acusado/a": "string",
    "edad_acusado/a al momento del hecho": "string", "nivel_instruccion_acusado/a": "string", "genero_denunciante": "string", "nacionalidad_denunciante": "string",
    "edad_denunciante_al_momento_del_hecho": "string", "nivel_instruccion_denunciante": "string", "frecuencia_episodios": "string",
    "relacion_y_tipo_entre_acusado/a_y_denunciante": "string", "hijos_hijas_en_comun": "string", "medidad_de_proteccion_vigentes_al_momento_del_hecho": "string",
    "zona_del_hecho": "string", "lugar_del_hecho": "string", "tipo_de_resolucion": "string", "objeto_de_la_resolucion": "string", "detalle": "string",
    "decision": "string", "oral_escrita": "string", "hora_de_inicio": "string", "hora_de_cierre": "string", "duracion": "string", "link": "string",
}
