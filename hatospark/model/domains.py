"""The words each closed text domain accepts, in declared order."""

# Fixed values.
ESTADO_USUARIO = ("activo", "inactivo", "bloqueado")
ESTADO_COLABORADOR = ("activo", "inactivo")
PROPOSITO_RAZA = ("Carne", "Lecheria", "Doble Propósito")
FUNCION_MANGA = (
    "Ordeño",
    "Cría",
    "Reproducción",
    "Preparto",
    "Novillas",
    "Ceba",
    "Lactancia",
    "Machos Levante",
    "Atención Veterinaria",
)
CAUSA_PRINCIPAL = ("Digestivo", "Diarrea", "Otros")
TIPO_ANIMAL = ("Vaca", "Toro", "Ternero")
SEXO = ("M", "F")
ESTADO_ANIMAL = ("Activo", "Inactivo", "Vendido", "Fallecido")
ESTADO_ORDENO = ("Activo", "Inactivo")
ESTADO_REPRODUCTIVO = ("Preñada", "Parida", "Vacía", "Seca", "Lactando")
TIPO_USO = ("Semental", "Ceba", "Levante")
LIBIDO = ("Alta", "Media", "Baja", "Sin evaluar")
ESTADO_LACTANCIA = ("Lactante", "Pre-destete", "Destetado")
ACCION_ANIMAL = ("Cambio Estado", "Muerte", "Venta", "Actualización")
TIPO_PRODUCTO = ("Vacuna", "Antibiótico", "Antiparasitario", "Vitamina", "Hormonal", "Otro")
TIPO_APLICACION = ("Individual", "Masivo")
CATEGORIA_SANITARIA = ("Tratamiento", "Vacunación", "Mastitis")
PROPOSITO_SANITARIO = ("Preventivo", "Correctivo")
DOSIS_UNIDAD = ("ml", "cc", "mg", "g", "uds")
REPETICION = ("Única", "Diaria", "Semanal", "Personalizada")
ESTADO_APLICACION = ("Pendiente", "Aplicado", "Cancelado")
CUARTO = ("Sana", "Subclínica", "Leve", "Moderada")
ESTADO_PROGRAMACION = ("Pendiente", "Aplicado", "Vencido", "Cancelado")
VIA_APLICACION = ("Intramuscular", "Subcutánea", "Oral", "Intravenosa", "Tópica", "Otro")
TIPO_EVENTO = ("Monta Natural", "Inseminación Artificial")
ESTADO_CICLO = (
    "Pendiente Palpación 1",
    "Preñez Provisional",
    "Vacía",
    "Preñez Confirmada",
    "Parto Exitoso",
    "Abortado",
)
RESULTADO_PALPACION = ("Preñada", "Vacía")
RESULTADO_PARTO = ("Exitoso", "Abortado")
TIPO_ALERTA_REPRODUCTIVA = (
    "Palpación 1",
    "Palpación 2",
    "Parto Estimado",
    "Seguimiento de Celo",
)
ESTADO_ALERTA_REPRODUCTIVA = ("Pendiente", "Completada", "Cancelada")
TIPO_BAJA = ("Venta", "Donación", "Descarte", "Retiro", "Otro")
TIPO_MOVIMIENTO = ("Compra", "Venta", "Producción", "Consumo", "Ajuste")
DESTINO_VENTA = ("Venta", "Consumo Animal")
CATEGORIA_FINANCIERA = ("ingreso", "gasto")
ESTADO_TRANSACCION = ("ejecutado", "pendiente")
TIPO_ORIGEN = (
    "Manual",
    "Compra Insumo",
    "Venta Insumo",
    "Venta Animal",
    "Ingreso Leche",
    "Gasto Sanitario",
    "Otro",
)
MODULO_ALERTA = (
    "Reproducción",
    "Gestión Sanitaria",
    "Mortalidad",
    "Producción",
    "Inventario",
    "General",
    "Sanidad",
)
PRIORIDAD = ("Urgente", "Normal", "Baja")
ESTADO_ALERTA = ("Pendiente", "Atendida", "Cancelada")
ACCION_ALERTA = ("Creada", "Modificada", "Atendida", "Cancelada", "Eliminada")
